"""Tag maps."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def sam_tags(mismatches: Column, score: Column, extra: Column | None = None) -> Column:
    """``NM`` and ``AS`` plus any tags the aligner adds."""
    own = F.create_map(F.lit("NM"), mismatches.cast("string"), F.lit("AS"), score.cast("string"))
    return own if extra is None else F.map_concat(own, extra)


def filter_tags(tags: Column, keep: Iterable[str] | None = None, ignore: Iterable[str] = ()) -> Column:
    """Tags to store: all, or those in ``keep``; never those in ``ignore``."""
    kept, dropped = None if keep is None else list(keep), list(ignore)

    def wanted(k: Column, _v: Column) -> Column:
        ok = F.lit(True) if kept is None else k.isin(kept)
        return ok & ~k.isin(dropped) if dropped else ok

    return F.map_filter(tags, wanted)


def tags_text(tags: Column) -> Column:
    """Tags sorted by name as tab-separated ``NAME:type:value`` fields."""
    entry = F.array_sort(F.map_entries(tags))
    return F.array_join(
        F.transform(
            entry,
            lambda e: F.concat(e["key"], F.when(e["value"].rlike("^-?[0-9]+$"), ":i:").otherwise(":Z:"), e["value"]),
        ),
        "\t",
    )
