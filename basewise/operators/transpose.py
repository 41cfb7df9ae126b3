"""Cycle blocks to clusters: block transposition, positional zip and pass filter.

On disk a run is columnar by cycle. The shuffle moves whole blocks (one row holds
the calls of up to ``block_size`` clusters in one cycle) keyed by (lane, tile,
block), never single bytes. A group is one block of one tile: cycles x block_size
bytes whatever the run's size, so no lane, tile or sample can make it large.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basewise.operators.layout import CycleRange, number_reads
from basewise.session import small_side

# Bytes under which the locations of a run may be broadcast.
LOCATION_BYTES = 128 << 20


def _binary(matrix: np.ndarray) -> pa.Array:
    """Rows of a uint8 matrix as a binary array that shares its memory."""
    rows, width = matrix.shape
    data = np.ascontiguousarray(matrix)
    offsets = np.arange(rows + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _pick(layout: dict[str, CycleRange], have: np.ndarray, missing: str) -> dict[str, np.ndarray]:
    """Row numbers of each read's cycles among the sorted cycles at hand."""
    out = {}
    for name, r in layout.items():
        at = np.flatnonzero((have >= r.first) & (have <= r.last))
        if missing == "error" and len(at) != r.last - r.first + 1:
            absent = sorted(set(range(r.first, r.last + 1)) - set(have[at].tolist()))
            raise ValueError(f"missing cycle file(s) for read {name}: {absent}")
        out[name] = at
    return out


def _block_function(layout: dict[str, CycleRange], block_size: int, missing: str) -> Callable[[pa.Table], pa.Table]:
    def build(table: pa.Table) -> pa.Table:
        cycles = table.column("cycle").to_numpy()
        order = np.argsort(cycles, kind="stable")
        lane, tile, block = (table.column(c)[0].as_py() for c in ("lane", "tile", "block"))
        where = f"lane {lane} tile {tile} block {block}"
        first = int(order[0])
        if cycles[first] != 0:
            raise ValueError(f"no filter block for {where}")
        payload = table.column("bytes").combine_chunks()

        def calls(row: int) -> np.ndarray:
            return np.frombuffer(payload[row].as_buffer(), dtype=np.uint8)

        # The filter acts here, before any call is copied: a filter placed behind
        # the function would not be pushed through it.
        passed = np.flatnonzero(calls(first) == 1)
        size = len(calls(first))
        have = cycles[order[1:]]
        if len(np.unique(have)) != len(have):
            raise ValueError(f"a cycle occurs twice in {where}")
        matrix = np.empty((len(passed), len(have)), dtype=np.uint8)
        for column, row in enumerate(order[1:]):
            block_calls = calls(int(row))
            if len(block_calls) != size:
                raise ValueError(f"cycle {have[column]} of {where} has {len(block_calls)} calls, filter has {size}")
            matrix[:, column] = block_calls[passed]
        n = len(passed)
        columns = {
            "lane": pa.array(np.full(n, lane, np.int32)),
            "tile": pa.array(np.full(n, tile, np.int32)),
            "cluster": pa.array(passed.astype(np.int64) + np.int64(block) * block_size),
        }
        xy_value = table.column("xy")[first].as_py()
        if xy_value is None:
            columns["x"] = columns["y"] = pa.nulls(n, pa.int32())
        else:
            xy = np.frombuffer(xy_value, dtype="<i4").reshape(-1, 2)
            if len(xy) < size:
                raise ValueError(f"{len(xy)} locations for the {size} clusters of {where}")
            columns["x"] = pa.array(xy[passed, 0])
            columns["y"] = pa.array(xy[passed, 1])
        for name, at in _pick(layout, have, missing).items():
            columns[name] = _binary(matrix[:, at])
        return pa.table(columns)

    return build


def transpose(
    calls: DataFrame,
    filters: DataFrame,
    ranges: list[CycleRange],
    locations: DataFrame | None = None,
    block_size: int = 65_536,
    missing: str = "error",
) -> DataFrame:
    """Passing clusters (lane, tile, cluster, x, y, r1, ..., i1, ...).

    ``calls`` is (lane, tile, cycle, block, bytes), ``filters`` the same without a
    cycle, ``locations`` (block, xy). The filter block travels as cycle 0 and the
    location block rides on it, so calls, filter and locations meet in one shuffle.
    ``missing="drop"`` shortens reads whose cycle files are absent.
    """
    if missing not in ("error", "drop"):
        raise ValueError(f"missing must be 'error' or 'drop', got {missing!r}")
    if locations is None:
        heads = filters.withColumn("xy", F.lit(None).cast("binary"))
    else:
        # A block of locations is 8 bytes per cluster: few rows, but wide ones.
        heads = filters.join(small_side(locations, max_rows=LOCATION_BYTES // (8 * block_size)), "block", "left")
    layout = number_reads(ranges)
    used = max(r.last for r in ranges)
    rows = calls.where(F.col("cycle").between(1, used)).select(
        "lane", "tile", "block", "cycle", "bytes", F.lit(None).cast("binary").alias("xy")
    ).unionByName(heads.select("lane", "tile", "block", F.lit(0).alias("cycle"), "bytes", "xy"))
    schema = "lane int, tile int, cluster long, x int, y int, " + ", ".join(f"{n} binary" for n in layout)
    return rows.groupBy("lane", "tile", "block").applyInArrow(_block_function(layout, block_size, missing), schema)


def cycle_blocks(clusters: DataFrame, block_size: int = 65_536) -> DataFrame:
    """The way back: (lane, tile, cluster, pf, calls) to cycle blocks, cycle 0 = filter.

    Used to lay out test runs. Absent cluster numbers become failing no-calls.
    """

    def pack(table: pa.Table) -> pa.Table:
        lane, tile, block = (table.column(c)[0].as_py() for c in ("lane", "tile", "block"))
        at = table.column("cluster").to_numpy() % block_size
        strings = table.column("calls").combine_chunks()
        width = len(strings[0].as_py())
        cells = np.zeros((int(at.max()) + 1, width + 1), dtype=np.uint8)
        cells[at, 0] = table.column("pf").to_numpy()
        cells[at, 1:] = np.frombuffer(b"".join(strings.to_pylist()), dtype=np.uint8).reshape(-1, width)
        n = width + 1
        return pa.table({
            "lane": pa.array(np.full(n, lane, np.int32)),
            "tile": pa.array(np.full(n, tile, np.int32)),
            "cycle": pa.array(np.arange(n, dtype=np.int32)),
            "block": pa.array(np.full(n, block, np.int32)),
            "bytes": _binary(cells.T),
        })

    keyed = clusters.select(
        "lane", "tile", "cluster", "pf", "calls", F.expr(f"cast(cluster div {int(block_size)} as int)").alias("block")
    )
    return keyed.groupBy("lane", "tile", "block").applyInArrow(
        pack, "lane int, tile int, cycle int, block int, bytes binary"
    )
