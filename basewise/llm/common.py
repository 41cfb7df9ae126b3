"""Pieces the operators share: table reading, stored tables, connected components."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basewise.session import materialize

#: Rows of one Arrow batch handed to Python code at once, and their bytes, unless one row has more.
SLICE, SLICE_BYTES = 512, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def field(df: DataFrame, column: str, name: str) -> T.StructField:
    """The type of ``column``, named ``name``, as an output field."""
    return T.StructField(name, df.schema[column].dataType, True)


def numbered(df: DataFrame, row_col: str | None = None, /, **columns: Column) -> DataFrame:
    """The given columns only, under names of our own, and ``row``: ``row_col``, or else a new number per row.

    Selecting first keeps extra columns of the input, whatever their names, out of
    the way. A new ``row`` depends on the partitions, so store it before it is used twice.
    """
    row = F.col(f"`{row_col}`").cast("long") if row_col else F.monotonically_increasing_id()
    return df.select(row.alias("row"), *[c.alias(n) for n, c in columns.items()])


def without(df: DataFrame, dropped: Callable[[DataFrame, str], DataFrame], label: str) -> DataFrame:
    """``df`` less the rows that ``dropped(df, row_col)`` names in a column ``row``.

    Rows are numbered and stored first, so that the number means the same row in both
    passes even where ids repeat.
    """
    row_col = "row"
    while row_col.lower() in {c.lower() for c in df.columns}:
        row_col += "_"
    stored = materialize(df.withColumn(row_col, F.monotonically_increasing_id()), label)
    gone = materialize(dropped(stored, row_col).select(F.col("row").alias("gone")), f"{label}-gone")
    return stored.join(gone, stored[row_col] == gone["gone"], "left_anti").drop(row_col)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of at most ``SLICE`` rows and ``SLICE_BYTES`` bytes; a row is never cut."""
    for batch in batches:
        open_ = [batch.slice(at, SLICE) for at in reversed(range(0, batch.num_rows, SLICE))]
        while open_:
            part = open_.pop()
            if part.num_rows > 1 and part.nbytes > SLICE_BYTES:
                half = part.num_rows // 2
                open_ += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def per_process(key: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once in a Python worker process, which serves many tasks.

    This package travels with each task, so its own globals are new in every one.
    """
    held = sys.modules.setdefault("basewise_worker_state", ModuleType("basewise_worker_state")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def map_batches(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """``rows`` over Arrow slices of ``df``; keeps nothing between slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield rows(batch)

    return df.mapInArrow(run, schema)


def fitted(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """``df`` in no more tasks than ``rows`` need at ``each`` a task: a small table in a wide session is no job of empty tasks."""
    return df.coalesce(max(1, -(-rows // each))) if rows < each * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node that has an edge, from ``a, b`` of long nodes.

    Rounds of contraction: under a new random order each node moves to its least
    neighbour, then edges are renamed; loops and repeats go. Each round's moves and edges
    are stored, and only their number comes to the driver; the moves are put one after
    the other at the end. Edges shrink by a constant factor a round, whatever the length
    of chains.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    first = edges = materialize(both.distinct(), "edges")
    nodes = left = edges.count()
    if not left:
        return first.select(F.col("a").alias("node"), F.col("b").alias("root"))
    moves = []
    while left:
        order = lambda c, k=len(moves): F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("h"), F.col(c).alias("v"))
        moved = materialize(
            fitted(edges.groupBy("a").agg(F.min(order("b")).alias("least"))
                   .select(F.col("a").alias("old"), F.least(order("a"), F.col("least"))["v"].alias("new")).filter("old <> new"), left),
            "moved",
        )
        moves.append(moved)
        one = edges.join(moved, edges.a == moved.old, "left").select(F.coalesce("new", "a").alias("a"), "b")
        two = one.join(moved, one.b == moved.old, "left").select("a", F.coalesce("new", "b").alias("b"))
        edges = materialize(fitted(two.filter("a <> b").distinct(), left), "edges")
        left = edges.count()
    labels = first.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    for moved in moves:
        labels = labels.join(moved, labels.root == moved.old, "left").select("node", F.coalesce("new", "root").alias("root"))
    labels = materialize(fitted(labels, nodes), "labels")
    return labels
