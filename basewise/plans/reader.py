"""Run folder to read pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewise.functions.decode import read_name
from basewise.operators.demux import demux_assign, table_of_contents
from basewise.operators.layout import CycleRange, enumerate_tiles, expected_files, missing_files
from basewise.operators.reads import decode_index, to_read_pairs, trim_pairs
from basewise.operators.transpose import transpose
from basewise.options import Options
from basewise.sinks import write_pairs, write_toc
from basewise.sources.calls import cycle_files, read_cycles, read_filters, tile_keys
from basewise.sources.locations import read_locations
from basewise.sources.manifest import read_manifest, run_ranges
from basewise.sources.sheet import read_sheet


@dataclass(frozen=True)
class Run:
    """What the manifest says: cycle ranges, (lane, tile) pairs, and instrument, run number and flowcell of read names."""

    ranges: list[CycleRange]
    tiles: list[tuple[int, int]]
    head: tuple[str, str, str]

    @property
    def cycles(self) -> int:
        return max(r.last for r in self.ranges)


def load_run(spark: SparkSession, options: Options) -> Run:
    """The run's manifest; one row is read."""
    run = read_manifest(spark, options.bcl_input_dir + "RunInfo.xml")
    head = run.select("instrument", "run_number", "flowcell").first()
    return Run(run_ranges(run), tile_keys(enumerate_tiles(run)), tuple(head))


def tile_clusters(
    spark: SparkSession, options: Options, run: Run, tiles: list[tuple[int, int]], missing: str = "error", locs_format: str = "locs"
) -> DataFrame:
    """Passing clusters of some tiles with raw reads, coordinates and name. No file of another tile or a later cycle is opened."""
    base = options.bcl_input_dir + options.base_dir
    clusters = transpose(
        read_cycles(spark, base, options.block_size, tiles, run.cycles),
        read_filters(spark, base, options.block_size, tiles),
        run.ranges,
        read_locations(spark, f"{base.rstrip('/')}/../s.{locs_format}", locs_format, options.block_size),
        options.block_size,
        missing,
    )
    return clusters.withColumn("name", read_name(*map(F.lit, run.head), *map(F.col, ("lane", "tile", "x", "y"))))


def run_clusters(
    spark: SparkSession, options: Options, missing: str = "error", locs_format: str = "locs"
) -> DataFrame:
    """Passing clusters of a run folder with raw reads, coordinates and name.

    Spark skips empty files without a word, so with ``missing="error"`` the files
    found are first checked against the manifest. That reads no file contents.
    """
    run = load_run(spark, options)
    if missing == "error":
        expected = expected_files(spark.createDataFrame(run.tiles, "lane int, tile int"), run.cycles)
        found = cycle_files(spark, options.bcl_input_dir + options.base_dir).where(F.col("length") > 0)
        absent = missing_files(expected, found).limit(5).collect()
        if absent:
            raise FileNotFoundError("missing cycle files, among them: " + ", ".join(str(tuple(r)) for r in absent))
    return tile_clusters(spark, options, run, run.tiles, missing, locs_format)


def assign_samples(spark: SparkSession, options: Options, clusters: DataFrame, all_index_reads: bool | None = None) -> DataFrame:
    """Clusters with ``idx`` and ``sample``. Raw reads are routed; decoding comes after.

    All index reads make the barcode if the options (or the argument) say so, else the first.
    """
    every = options.dual_index if all_index_reads is None else all_index_reads
    sheet = read_sheet(spark, options.sample_sheet, every)
    return demux_assign(decode_index(clusters, every), sheet, options.mismatches, options.undet)


def pairs_of(spark: SparkSession, options: Options, clusters: DataFrame) -> DataFrame:
    """Read pairs of clusters, masked from the adapter on if the options name one."""
    pairs = to_read_pairs(assign_samples(spark, options, clusters))
    return trim_pairs(pairs, options.adapter) if options.adapter else pairs


def run_pairs(spark: SparkSession, options: Options, missing: str = "error", locs_format: str = "locs") -> DataFrame:
    """Read pairs of every sample of a run folder."""
    return pairs_of(spark, options, run_clusters(spark, options, missing, locs_format))


def contents(spark: SparkSession, options: Options) -> DataFrame:
    """The reader's table of contents (key 0)."""
    return table_of_contents(read_sheet(spark, options.sample_sheet, options.dual_index), 0, options.undet)


def read_run(spark: SparkSession, options: Options, out: str, missing: str = "error") -> None:
    """The reader program: contents first (key 0), then the pairs."""
    write_toc(contents(spark, options), f"{out}/toc")
    write_pairs(run_pairs(spark, options, missing), f"{out}/pairs", mode="append")
