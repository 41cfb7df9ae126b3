"""Cluster location files, plain and compressed."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from basewise import schemas

# Fixed values of the formats.
LOCS_HEADER = 12
SCALE, ORIGIN = 10, 1000.5
CLOCS_HEADER = 1
BINS_PER_ROW, BIN_STEP = 82, 250


def parse_locs(content: bytes) -> np.ndarray:
    """(n, 2) int32 coordinates of a plain file: float32 pairs, scaled as doubles and truncated."""
    xy = np.frombuffer(content, dtype="<f4", offset=LOCS_HEADER).astype(np.float64)
    return np.trunc(xy * SCALE + ORIGIN).astype("<i4").reshape(-1, 2)


def parse_clocs(content: bytes) -> np.ndarray:
    """(n, 2) int32 coordinates of a compressed file: byte offsets inside a grid of bins."""
    (bins,) = struct.unpack_from("<i", content, CLOCS_HEADER)
    at = CLOCS_HEADER + 4
    parts = []
    for n in range(bins):
        count = content[at]
        inside = np.frombuffer(content, dtype=np.uint8, count=2 * count, offset=at + 1).reshape(-1, 2)
        corner = (int(ORIGIN + n % BINS_PER_ROW * BIN_STEP), int(ORIGIN + n // BINS_PER_ROW * BIN_STEP))
        parts.append(inside.astype("<i4") + np.array(corner, dtype="<i4"))
        at += 1 + 2 * count
    return np.concatenate(parts) if parts else np.empty((0, 2), dtype="<i4")


PARSERS: dict[str, Callable[[bytes], np.ndarray]] = {"locs": parse_locs, "clocs": parse_clocs}


def read_locations(spark: SparkSession, path: str, locs_format: str = "locs", block_size: int = 65_536) -> DataFrame:
    """(block, xy): packed coordinates of each block of clusters, the same for every tile."""
    parse = PARSERS[locs_format]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                xy = parse(content)
                cuts = [xy[at : at + block_size].tobytes() for at in range(0, len(xy), block_size)]
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array(np.arange(len(cuts), dtype=np.int32)), "xy": pa.array(cuts, pa.binary())
                })

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(blocks, schemas.LOCS_BLOCKS)


def location_rows(blocks: DataFrame, block_size: int = 65_536) -> DataFrame:
    """(cluster, x, y), one row per cluster."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                xy = np.frombuffer(r["xy"], dtype="<i4").reshape(-1, 2)
                yield pa.RecordBatch.from_pydict({
                    "cluster": pa.array(np.arange(len(xy), dtype=np.int64) + r["block"] * block_size),
                    "x": pa.array(np.ascontiguousarray(xy[:, 0])), "y": pa.array(np.ascontiguousarray(xy[:, 1])),
                })

    return blocks.select("block", "xy").mapInArrow(rows, "cluster long, x int, y int")
