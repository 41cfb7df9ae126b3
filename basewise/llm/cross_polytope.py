"""Approximate nearest neighbours by cross-polytope hashing.

A fast pseudo-rotation (three rounds of random signs and a Hadamard transform) turns a
unit vector; its hash is the nearest signed axis. Every vector is filed under one axis
in each table; a query visits its nearest axes in each table (multiprobe). The vectors
found are ranked by their exact distance, in blocks of bounded size, so neither a
crowded axis nor many queries gather in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basewise.session import materialize

#: Tables and axes visited in each: recall at ten of 0.94 and more on the test tables, see README.
TABLES, PROBES, SEED = 8, 16, 17
#: Vectors or queries of one block.
BLOCK = 2048


def transform(values: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row (a power of two wide), scaled to keep lengths."""
    n, width = values.shape
    step = 1
    while step < width:
        pairs = values.reshape(n, -1, 2, step)
        values = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(n, width)
        step *= 2
    return values / np.sqrt(width)


def rotated(vectors: np.ndarray, number: int, seed: int = SEED) -> np.ndarray:
    """The rotation of one table, over rows padded with zeros to a power of two."""
    width = 1 << max(0, (vectors.shape[1] - 1).bit_length())
    out = np.zeros((len(vectors), width))
    out[:, :vectors.shape[1]] = vectors
    signs = np.random.Generator(np.random.PCG64([seed, number, width])).choice([-1.0, 1.0], (3, width))
    for row in signs:
        out = transform(out * row)
    return out


def axes(vectors: np.ndarray, number: int, probes: int, seed: int = SEED) -> np.ndarray:
    """For each row its ``probes`` nearest signed axes, nearest first: axis i, or width + i for its negative."""
    turned = rotated(vectors, number, seed)
    both = np.concatenate([turned, -turned], axis=1)
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` (array of double) without vectors that are null, zero, or hold null or non-finite components."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0)
    )


def _filed(rows: DataFrame, probes: int, tables: int, seed: int) -> DataFrame:
    """``vec_id, v, dims, place`` for each table and axis; ``place`` counts tables and axes."""
    schema = "vec_id long, v array<double>, dims int, places array<int>"

    def run(parts):
        for part in parts:
            out = []
            for dims, own in part.groupby(part["v"].map(len)):
                vectors = np.stack(own["v"].to_numpy()).astype(float)
                units = vectors / np.abs(vectors).max(axis=1, keepdims=True)
                units /= np.linalg.norm(units, axis=1, keepdims=True)
                width = 2 << max(0, (int(dims) - 1).bit_length())
                places = np.concatenate([t * width + axes(units, t, min(probes, width), seed) for t in range(tables)], axis=1)
                out.append(own.assign(dims=np.int32(dims), places=list(places.astype(np.int32))))
            yield pd.concat(out) if out else pd.DataFrame({"vec_id": [], "v": [], "dims": [], "places": []})

    return rows.mapInPandas(run, schema).withColumn("place", F.explode("places")).drop("places")


def _search(queries: DataFrame, filed: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score``: the k best of each pair of a block of queries and a block of vectors at one place."""
    keys = ["dims", "place"]

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))

    # At most (tables x axes) rows for each width of vectors.
    grid = materialize(blocks(queries, "nq").join(blocks(filed, "nv"), keys), "grid")

    def spread(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        dealt = df.join(grid, keys).withColumn(mine, F.pmod(F.xxhash64("vec_id", F.lit(mine)), F.col(own)).cast("int"))
        return dealt.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select(*keys, "bq", "bv", "vec_id", "v")

    left = spread(queries, "nq", "nv", "bq", "bv").groupBy(*keys, "bq", "bv")
    right = spread(filed, "nv", "nq", "bv", "bq").groupBy(*keys, "bq", "bv")
    return left.cogroup(right).applyInPandas(lambda q, v: _nearest(q, v, k), "query_id long, vec_id long, score double")


def _nearest(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(queries) or not len(vectors):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    vectors = vectors.sort_values("vec_id")
    ids, all_v = vectors["vec_id"].to_numpy(), np.stack(vectors["v"].to_numpy()).astype(float)
    squares, out = (all_v * all_v).sum(axis=1), []
    for query, v in zip(queries["vec_id"], queries["v"]):
        q = np.asarray(v, dtype=float)
        # A cheap distance leaves the few whose exact one may be among the k smallest.
        rough = squares - 2 * (all_v @ q) + q @ q
        rough[ids == query] = np.inf
        slack = 1e-9 * (squares.max() + q @ q)
        limit = np.partition(rough, k - 1)[k - 1] + slack if len(rough) > k else np.inf
        near = np.flatnonzero((rough <= limit) & (ids != query))
        exact = np.sqrt(((all_v[near] - q) ** 2).sum(axis=1))
        best = near[np.argsort(exact, kind="stable")[:k]]
        out.append(pd.DataFrame({"query_id": query, "vec_id": ids[best], "score": np.sqrt(((all_v[best] - q) ** 2).sum(axis=1))}))
    return pd.concat(out)


def search(
    df: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, probes: int = PROBES, seed: int = SEED
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each row for which ``is_query(vec_id)`` holds.

    ``score`` is the Euclidean distance of the original vectors in double precision;
    ties go to the smaller id. All other rows are candidates, and only those of the
    same width. Vectors that are null, zero, or hold null or non-finite components take
    no part, nor do null ids; a repeated id counts once, with its least vector. A query
    for which the tables give fewer than k is ranked against all rows, in blocks. An
    empty table gives no rows; other columns are never read.
    """
    rows = materialize(usable(df, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    asked = rows.filter(is_query(F.col("vec_id")))
    found = materialize(_search(_filed(asked, probes, tables, seed), _filed(rows, 1, tables, seed), k).distinct(), "found")
    short = materialize(asked.join(found.groupBy("query_id").count().filter(F.col("count") >= k), F.col("vec_id") == F.col("query_id"), "left_anti"), "short")
    everywhere = lambda df: df.withColumn("dims", F.size("v")).withColumn("place", F.lit(0))
    if not short.isEmpty():
        found = found.union(_search(everywhere(short), everywhere(rows), k)).distinct()
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
