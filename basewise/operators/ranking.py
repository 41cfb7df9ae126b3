"""Row numbers inside groups of any size.

``row_number() over (partition by sample ...)`` sorts a whole sample in one task.
Here the rows are range-partitioned on the full order instead, numbered inside
each range, and shifted by the row counts of the earlier ranges. A sample with a
third of all rows spreads over a third of the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basewise.session import materialize, small_side


def ranked_with_counts(
    df: DataFrame, group: list[str], order: list[Column], name: str = "rn", by: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """``df`` with a 1-based ``name`` per ``group``, in ``order``, and the row counts (``_n``) per ``group`` and ``by``.

    ``order`` must be unique inside a group. The sorted rows are written to the
    shared folder, because ranges and row positions must be the same for the
    counts and for the rows they shift. The counts are made from a stored table with
    one row per range, plus one per value of ``group`` and ``by`` that starts inside
    a range, so they cost no pass over the rows.

    Finding the ranges samples the input: its last stage runs twice, earlier shuffles
    are reused. Pass a stored table where that last stage is dear.
    """
    by = by or []
    keys = [F.col(g) for g in group] + list(order)
    row_id = F.monotonically_increasing_id()
    placed = materialize(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", row_id.alias("_row")).select(
            *df.columns,
            F.shiftright("_row", 33).alias("_range"),
            F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"),
        ),
        "ranked",
    )
    fine = materialize(
        placed.groupBy("_range", *group, *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")), "range-counts"
    )
    counts = fine.groupBy("_range", *group).agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first"))
    earlier = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    shift = counts.select(
        "_range", *group, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift")
    )
    numbered = placed.join(small_side(shift), ["_range", *group]).select(
        *df.columns, (F.col("_at") + F.col("_shift")).alias(name)
    )
    return numbered, fine.groupBy(*group, *by).agg(F.sum("_n").alias("_n"))


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    """``df`` with a 1-based ``name`` per ``group``, as :func:`ranked_with_counts` has it."""
    return ranked_with_counts(df, group, order, name)[0]


def round_robin(df: DataFrame, slots: int, group: list[str], order: list[Column]) -> DataFrame:
    """Rows of each group dealt out over ``slots`` in turn, reproducibly."""
    numbered = ranked(df, group, order, "_rn")
    return numbered.select(*df.columns, ((F.col("_rn") - 1) % slots).cast("int").alias("slot"))


def count_windows(df: DataFrame, size: int, group: list[str], order: list[Column]) -> DataFrame:
    """Consecutive windows of ``size`` rows per group; the last may be short."""
    numbered = ranked(df, group, order, "_rn")
    return numbered.select(*df.columns, F.expr(f"(_rn - 1) div {int(size)}").alias("window"))


def coordinate_sort(df: DataFrame) -> DataFrame:
    """Total order by (sample, contig, position), unmapped reads last.

    One range shuffle and a local sort: no numbering and no single-task sort. Pass a
    stored table, as finding the ranges reads the input once more.
    """
    keys = coordinate_keys()
    return df.repartitionByRange("sample", *keys).sortWithinPartitions("sample", *keys)


def coordinate_keys() -> list[Column]:
    """Order of records in a coordinate-sorted file."""
    return [F.coalesce(F.col("ref_idx") == -1, F.lit(True)), F.col("ref_idx"), F.col("pos"), F.col("name"), F.col("read_no")]
