"""Starts one of the three programs: ``python -m basewise reader --properties run.properties --data hdfs:///work/run7``.

Further ``--key value`` pairs override the properties. ``--data`` is the folder that the
programs pass on to each other; the writer's output goes to ``cram_output_dir``. With
``--live 1`` a program works while the one before it still writes; its state lies below
``flink_tmp_dir``, and ``aligner_timeout`` and ``writer_timeout`` end it when all is quiet.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from basewise.options import OptionError, Options
from basewise.plans.aligner import align_run
from basewise.plans.reader import read_run
from basewise.plans.writer import write_run
from basewise.sources.tables import read_reference
from basewise.streaming.control import run_live
from basewise.streaming.live import LiveWriter, live_aligner
from basewise.streaming.reader import stream_run

PROGRAMS = ("reader", "aligner", "writer")


def arguments(argv: list[str]) -> tuple[str, dict[str, str]]:
    """The program and its ``--key value`` (or ``--key=value``) pairs."""
    if not argv or argv[0] not in PROGRAMS:
        raise OptionError("the first argument must be one of " + ", ".join(PROGRAMS))
    given, rest = {}, iter(argv[1:])
    for arg in rest:
        if not arg.startswith("--"):
            raise OptionError(f"expected --key, got {arg!r}")
        key, has_value, value = arg[2:].partition("=")
        given[key] = value if has_value else next(rest, None)
        if given[key] is None:
            raise OptionError(f"--{key} has no value")
    return argv[0], given


def run_program_live(spark: SparkSession, program: str, options: Options, data: str) -> None:
    state = f"{options.flink_tmp_dir.rstrip('/')}/{program}"
    if program == "reader":
        stream_run(spark, options, data, state).awaitTermination()
    elif program == "aligner":
        run_live([live_aligner(spark, options, data, read_reference(spark, options.reference), state)])
    else:
        run_live([LiveWriter(spark, options, data, state)])


def main(argv: list[str], spark: SparkSession | None = None) -> None:
    program, given = arguments(argv)
    if "data" not in given:
        raise OptionError("--data must name the work folder")
    data, properties, live = given.pop("data"), given.pop("properties", None), given.pop("live", "0") == "1"
    unknown = sorted(set(given) - set(Options.__dataclass_fields__))
    if unknown:
        raise OptionError("unknown option(s): " + ", ".join(unknown))
    spark = spark or SparkSession.builder.appName(f"basewise-{program}").getOrCreate()
    text = "" if properties is None else "\n".join(r["value"] for r in spark.read.text(properties, wholetext=True).collect())
    options = Options.from_dict(text, given)
    if live:
        run_program_live(spark, program, options, data)
    elif program == "reader":
        read_run(spark, options, data)
    elif program == "aligner":
        align_run(spark, data, read_reference(spark, options.reference), options.seed_length)
    else:
        write_run(spark, data, read_reference(spark, options.reference), options.cram_output_dir)


if __name__ == "__main__":
    main(sys.argv[1:])
