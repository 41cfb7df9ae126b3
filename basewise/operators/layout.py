"""Run layout: cycle ranges of the reads and the tile manifest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CycleRange:
    """Cycles ``first`` to ``last`` (1-based, inclusive) of one read of a run."""

    read_no: int
    is_index: bool
    first: int
    last: int


def cycle_ranges(reads: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(read_no, num_cycles, is_index) to first and last cycle, per run in ``by``.

    A run has a handful of reads, so its window is a handful of rows.
    """
    keys = by or []
    w = W.partitionBy(*keys).orderBy("read_no").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("num_cycles").over(w), F.lit(0)).cast("int")
    return reads.select(
        *keys,
        "read_no",
        "is_index",
        (before + 1).alias("first_cycle"),
        (before + F.col("num_cycles")).cast("int").alias("last_cycle"),
    )


def number_reads(ranges: list[CycleRange]) -> dict[str, CycleRange]:
    """Column names of a run's reads: ``r1, r2, ...`` and ``i1, i2, ...`` in cycle order."""
    out: dict[str, CycleRange] = {}
    for r in sorted(ranges, key=lambda r: r.first):
        kind = "i" if r.is_index else "r"
        out[f"{kind}{1 + sum(k[0] == kind for k in out)}"] = r
    return out


def tile_id(surface: Column, swath: Column, tile: Column) -> Column:
    """Tile number as printed in file names."""
    return (surface * 1000 + swath * 100 + tile).cast("int")


def enumerate_tiles(layout: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Every (lane, tile) of a layout row (lanes, surfaces, swaths, tiles).

    The product grows out of the layout row itself, so nothing is joined.
    """
    keys = by or []

    def up_to(c: str) -> Column:
        return F.explode(F.sequence(F.lit(1), F.col(c)))

    return (
        layout.select("*", up_to("lanes").alias("lane"))
        .select("*", up_to("surfaces").alias("_surface"))
        .select("*", up_to("swaths").alias("_swath"))
        .select("*", up_to("tiles").alias("_tile"))
        .select(*keys, F.col("lane").cast("int").alias("lane"), tile_id(F.col("_surface"), F.col("_swath"), F.col("_tile")).alias("tile"))
    )


def expected_files(tiles: DataFrame, cycles: int) -> DataFrame:
    """One row per cycle file a complete run must have."""
    return tiles.select("lane", "tile", F.explode(F.sequence(F.lit(1), F.lit(cycles))).alias("cycle"))


def missing_files(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected (lane, tile, cycle) rows without a file."""
    return expected.join(found.select("lane", "tile", "cycle"), ["lane", "tile", "cycle"], "left_anti")
