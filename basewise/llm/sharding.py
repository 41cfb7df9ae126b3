"""Uniform shuffle into shards by a hypergeometric communication matrix.

How many rows each input partition sends to each shard is drawn exactly, as a uniform
shuffle would have it: a row of the matrix is multivariate hypergeometric in the places
still free. Rows are permuted within their partition, dealt by the matrix, exchanged,
and permuted again within the shard. Shard sizes are exact by construction.
"""

from __future__ import annotations

from math import e, floor, lgamma, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basewise.llm.common import map_batches, text_of
from basewise.session import materialize


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Rows of each shard: at most one apart."""
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], dtype=np.int64)


def communication(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows from each partition (first axis) to each shard, drawn exactly."""
    random, free = np.random.Generator(np.random.PCG64(seed)), shard_sizes(sum(counts), shards)
    out = np.zeros((len(counts), shards), dtype=np.int64)
    for p, n in enumerate(counts):
        out[p] = _draw(random, free, n)
        free = free - out[p]
    return out


def _draw(random: np.random.Generator, free: np.ndarray, n: int) -> np.ndarray:
    """One multivariate hypergeometric draw, as one hypergeometric draw after the other."""
    out, rest = np.zeros(len(free), dtype=np.int64), int(free.sum())
    for s, have in enumerate(free.tolist()):
        rest -= have
        out[s] = _hypergeometric(random, have, rest, n)
        n -= int(out[s])
    return out


def _hypergeometric(random: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among ``n`` drawn from ``good + bad``; by ratio of uniforms (Stadlober 1989) beyond numpy's limit."""
    if n == 0 or good == 0 or bad == 0:
        return n if bad == 0 else 0
    total = good + bad
    if total < 10**9:
        return int(random.hypergeometric(good, bad, n))

    def weight(k: int) -> float:
        return -(lgamma(k + 1) + lgamma(good - k + 1) + lgamma(n - k + 1) + lgamma(bad - n + k + 1))

    share, low, high = good / total, max(0, n - bad), min(n, good)
    middle = n * share + 0.5
    # Width of the table mountain hat around the mode.
    width = 2 * sqrt(2 / e) * sqrt(n * share * (1 - share) * (total - n) / (total - 1) + 0.5) + 3 - 2 * sqrt(3 / e)
    top = weight((n + 1) * (good + 1) // (total + 2))
    while True:
        u, v = 1 - random.random(), random.random()
        k = floor(middle + width * (v - 0.5) / u)
        if low <= k <= high and 2 * log(u) <= weight(k) - top:
            return k


def utf8_size(column: str) -> Column:
    """Bytes of the text in UTF-8 plus one; null has no bytes."""
    return (F.coalesce(F.octet_length(F.col(f"`{column}`").cast("string")), F.lit(0)) + 1).cast("long")


def _random(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def assign(rows: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``rows`` (stored, narrow, with a unique long ``row``) with ``shard`` and ``slot``, gapless from 0 in each shard."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Partitions of the exchange: dealt by a hash of the row, so that none is hot, and the same in every attempt.
    dealt = rows.withColumn("part", F.pmod(_random(seed, "row"), F.lit(parts)).cast("int"))
    counts = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}
    edges = np.cumsum(communication([counts.get(p, 0) for p in range(parts)], shards, seed), axis=1)
    order = Window.partitionBy("part").orderBy(_random(seed + 1, "row"), "row")
    local = dealt.withColumn("at", F.row_number().over(order) - 1)
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType())])

    def send(batch: pa.RecordBatch) -> pa.RecordBatch:
        part, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "at"))
        shard = (edges[part] <= at[:, None]).sum(axis=1)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(shard, pa.int32())], names=[*names, "shard"])

    sent = materialize(map_batches(local, send, schema), "sent")
    # The second permutation is cut into bins by the random order, so a shard is as many tasks as there are bins.
    key = _random(seed + 2, "row")
    binned = sent.withColumn("bin", F.pmod(F.shiftrightunsigned(key, 20), F.lit(parts)).cast("int"))
    sizes = binned.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    base = sizes.select("shard", "bin", (F.sum("n").over(Window.partitionBy("shard").orderBy("bin")) - F.col("n")).alias("base"))
    within = F.row_number().over(Window.partitionBy("shard", "bin").orderBy(key, "row"))
    return (
        binned.withColumn("within", within - 1).join(base, ["shard", "bin"])
        .select(*rows.columns, "shard", (F.col("base") + F.col("within")).alias("slot"))
    )


def shard_table(df: DataFrame, shards: int = 16, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, id, size, text_crc32, shard, slot`` of each row, by the law of equal row counts.

    A null text has size 1 and the checksum of an empty one. Repeated rows are rows of
    their own. An empty table gives no rows; other columns are never read.
    """
    narrow = df.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), utf8_size(text_col).alias("size"),
        F.crc32(text_of(text_col).cast("binary")).alias("text_crc32"),
    )
    return assign(materialize(narrow, "narrow"), shards, seed)


def write_shards(df: DataFrame, path: str, shards: int = 16, seed: int = 0) -> None:
    """Writes whole rows to ``path``/shard=<n>, each file in the order of its slots, with ``slot`` as a column.

    ``df`` may have columns named ``row``, ``shard`` or ``slot``; they are kept under a
    struct named ``source``, as are all of its columns.
    """
    stored = materialize(df.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("source")), "whole")
    placed = assign(materialize(stored.select("row"), "rows"), shards, seed)
    whole = stored.join(placed, "row").select("source", "shard", "slot")
    whole.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
