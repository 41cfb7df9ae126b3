"""Cycle, filter and control files as blocks of bytes.

Files are read whole by Spark's ``binaryFile`` source, one task per input split, and
cut into blocks inside the task. A gzip file cannot be split, but a run has one per
cycle and tile, which is parallel enough.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basewise import schemas

# Bytes before the data.
CYCLE_HEADER = 4
FILTER_HEADER = 12
CONTROL_HEADER = 12

CYCLE_PATH = r"L(\d{3})/C(\d+)\.1/s_(\d+)_(\d+)\.bcl\.gz$"
TILE_PATH = r"L(\d{3})/s_(\d+)_(\d+)\.(?:filter|control)$"


#: What a binary file stream gives. ``content`` is read only where it is selected.
BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def _files(spark: SparkSession, base_dir: str, pattern: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(base_dir)
    )


def tile_keys(tiles: DataFrame) -> list[tuple[int, int]]:
    """(lane, tile) pairs, sorted: at most those of one run's manifest."""
    return sorted({(r["lane"], r["tile"]) for r in tiles.select("lane", "tile").collect()})


def _any_of(values: list[str]) -> str:
    return values[0] if len(values) == 1 else "{" + ",".join(values) + "}"


def cycle_glob(base_dir: str, tiles: list[tuple[int, int]], cycles: int) -> str:
    """The path pattern of the first ``cycles`` cycles of some tiles: no other file is listed, far less opened."""
    lanes = _any_of([f"{lane:03d}" for lane in sorted({lane for lane, _ in tiles})])
    names = _any_of([f"s_{lane}_{tile}" for lane, tile in tiles])
    return f"{base_dir.rstrip('/')}/L{lanes}/C{_any_of([str(c) for c in range(1, cycles + 1)])}.1/{names}.bcl.gz"


def filter_glob(base_dir: str, tiles: list[tuple[int, int]], kind: str = "filter") -> str:
    """The path pattern of the filter (or control) files of some tiles."""
    lanes = _any_of([f"{lane:03d}" for lane in sorted({lane for lane, _ in tiles})])
    return f"{base_dir.rstrip('/')}/L{lanes}/{_any_of([f's_{lane}_{tile}' for lane, tile in tiles])}.{kind}"


def stream_arrivals(spark: SparkSession, base_dir: str, files_per_batch: int) -> DataFrame:
    """(lane, tile, cycle) of each cycle or filter file (cycle 0) as it comes. Names alone are read.

    A file counts when it is first seen, so files must be moved into place whole.
    """
    found = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", "s_*.{bcl.gz,filter}")
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(base_dir)
    )
    is_cycle = F.col("path").rlike(CYCLE_PATH)
    part = lambda group, own: F.when(is_cycle, _from_path(CYCLE_PATH, group)).otherwise(own)
    return found.where((F.col("length") > 0) & (is_cycle | F.col("path").rlike(TILE_PATH))).select(
        part(1, _from_path(TILE_PATH, 1)).alias("lane"), part(4, _from_path(TILE_PATH, 3)).alias("tile"), part(2, F.lit(0)).alias("cycle"),
    )


def _from_path(regex: str, group: int) -> Column:
    return F.regexp_extract("path", regex, group).cast("int")


def cycle_files(spark: SparkSession, base_dir: str) -> DataFrame:
    """(lane, tile, cycle, length) of the cycle files present; contents are not read."""
    return _files(spark, base_dir, "s_*.bcl.gz").where(F.col("path").rlike(CYCLE_PATH)).select(
        _from_path(CYCLE_PATH, 1).alias("lane"), _from_path(CYCLE_PATH, 4).alias("tile"),
        _from_path(CYCLE_PATH, 2).alias("cycle"), "length",
    )


def _cut(batches: Iterator[pa.RecordBatch], keys: list[str], header: int, width: int, zipped: bool, block_size: int) -> Iterator[pa.RecordBatch]:
    """One output batch per file: its keys, block numbers and block bytes."""
    step = block_size * width
    for batch in batches:
        contents = batch.column(batch.schema.get_field_index("content"))
        for row in range(batch.num_rows):
            raw = contents[row].as_buffer()
            body = memoryview(gzip.decompress(raw) if zipped else raw)[header:]
            blocks = [bytes(body[at : at + step]) for at in range(0, len(body), step)]
            columns = {
                k: pa.array(np.full(len(blocks), batch.column(batch.schema.get_field_index(k))[row].as_py(), np.int32))
                for k in keys
            }
            columns["block"] = pa.array(np.arange(len(blocks), dtype=np.int32))
            columns["bytes"] = pa.array(blocks, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)


def read_cycles(
    spark: SparkSession, base_dir: str, block_size: int = 65_536, tiles: list[tuple[int, int]] | None = None, cycles: int | None = None
) -> DataFrame:
    """(lane, tile, cycle, block, bytes): one byte per cluster.

    With ``tiles`` and ``cycles`` only files of those are listed and opened.
    """
    found = _files(spark, cycle_glob(base_dir, tiles, cycles) if tiles and cycles else base_dir, "s_*.bcl.gz")
    keyed = found.where(F.col("path").rlike(CYCLE_PATH)).select(
        _from_path(CYCLE_PATH, 1).alias("lane"), _from_path(CYCLE_PATH, 4).alias("tile"),
        _from_path(CYCLE_PATH, 2).alias("cycle"), "content",
    )
    return keyed.mapInArrow(
        lambda it: _cut(it, ["lane", "tile", "cycle"], CYCLE_HEADER, 1, True, block_size), schemas.CALL_BLOCKS
    )


def _tile_files(spark: SparkSession, base_dir: str, pattern: str) -> DataFrame:
    return _files(spark, base_dir, pattern).where(F.col("path").rlike(TILE_PATH)).select(
        _from_path(TILE_PATH, 1).alias("lane"), _from_path(TILE_PATH, 3).alias("tile"), "content"
    )


def read_filters(spark: SparkSession, base_dir: str, block_size: int = 65_536, tiles: list[tuple[int, int]] | None = None) -> DataFrame:
    """(lane, tile, block, bytes): 1 where the cluster passed."""
    return _tile_files(spark, filter_glob(base_dir, tiles) if tiles else base_dir, "s_*.filter").mapInArrow(
        lambda it: _cut(it, ["lane", "tile"], FILTER_HEADER, 1, False, block_size), schemas.FILTER_BLOCKS
    )


def _controls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            values = np.frombuffer(row["content"], dtype="<i2", offset=CONTROL_HEADER)
            n = len(values)
            yield pa.RecordBatch.from_pydict({
                "lane": pa.array(np.full(n, row["lane"], np.int32)), "tile": pa.array(np.full(n, row["tile"], np.int32)),
                "cluster": pa.array(np.arange(n, dtype=np.int64)), "control": pa.array(values.astype(np.int16)),
            })


def read_controls(spark: SparkSession, base_dir: str) -> DataFrame:
    """(lane, tile, cluster, control, text): a number per cluster, and as printed (``n:``)."""
    return _tile_files(spark, base_dir, "s_*.control").mapInArrow(
        _controls, "lane int, tile int, cluster long, control smallint"
    ).withColumn("text", F.concat(F.col("control").cast("string"), F.lit(":")))
