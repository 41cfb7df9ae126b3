"""Run options: a properties text with overrides on top."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields


class OptionError(ValueError):
    """A mandatory option is missing or a value cannot be read."""


def parse_properties(text: str) -> dict[str, str]:
    """``key = value`` (or ``key: value``) lines; ``#`` and ``!`` start comments."""
    out: dict[str, str] = {}
    for raw in text.splitlines():
        line = raw.strip()
        if not line or line[0] in "#!":
            continue
        cut = min((i for i in (line.find("="), line.find(":")) if i >= 0), default=-1)
        if cut < 0:
            out[line] = ""
        else:
            out[line[:cut].strip()] = line[cut + 1 :].strip()
    return out


@dataclass(frozen=True)
class Options:
    """Options of the three programs. The first four must be given.

    Names and defaults are fixed values: existing property files must keep working.
    """

    bcl_input_dir: str
    cram_output_dir: str
    reference: str
    # Folder for streaming state and checkpoints.
    flink_tmp_dir: str
    sample_sheet: str = ""
    undet: str = "Undetermined"
    base_dir: str = "Data/Intensities/BaseCalls/"
    mismatches: int = 1
    # Clusters per transposed block. A shuffle unit here, hence larger than 2,048.
    block_size: int = 65_536
    # Read pairs per alignment batch.
    rapi_win: int = 3360
    # Bases of the words that find candidates: 19 for genomes, about 12 for short reads on small references.
    seed_length: int = 19
    adapter: str = ""
    # Whether all index reads make the barcode (1), or the first alone (0).
    dual_index: int = 0
    kafka_server: str = "127.0.0.1:9092"
    kafka_prq: str = "flink-prq"
    kafka_aligned: str = "flink-aligned"
    # Seconds without input after which a streaming program stops; 0 = never.
    aligner_timeout: int = 0
    writer_timeout: int = 0

    MANDATORY = ("bcl_input_dir", "cram_output_dir", "reference", "flink_tmp_dir")

    @classmethod
    def from_dict(
        cls, properties: Mapping[str, str] | str, overrides: Mapping[str, str] | None = None
    ) -> Options:
        """Merge a properties mapping (or file text) with overrides, which win."""
        base = parse_properties(properties) if isinstance(properties, str) else dict(properties)
        merged = {**base, **(overrides or {})}
        missing = [k for k in cls.MANDATORY if not merged.get(k)]
        if missing:
            raise OptionError("missing mandatory option(s): " + ", ".join(missing))
        args: dict[str, object] = {}
        for f in fields(cls):
            if f.name not in merged:
                continue
            value: object = merged[f.name]
            if f.type == "int":
                try:
                    value = int(str(value))
                except ValueError as e:
                    raise OptionError(f"option {f.name} must be a number: {value!r}") from e
            args[f.name] = value
        if not str(args["bcl_input_dir"]).endswith("/"):
            args["bcl_input_dir"] = f"{args['bcl_input_dir']}/"
        args.setdefault("sample_sheet", f"{args['bcl_input_dir']}SampleSheet.csv")
        return cls(**args)  # type: ignore[arg-type]
