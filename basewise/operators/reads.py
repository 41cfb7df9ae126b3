"""Clusters with raw reads to decoded records."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basewise.functions import adapter as ad
from basewise.functions import decode


def read_columns(columns: Iterable[str]) -> list[str]:
    """Raw non-index read columns (r1, r2, ...) in order."""
    return sorted((c for c in columns if c[0] == "r" and c[1:].isdigit()), key=lambda c: int(c[1:]))


def index_columns(columns: Iterable[str]) -> list[str]:
    """Raw index read columns (i1, i2, ...) in order."""
    return sorted((c for c in columns if c[0] == "i" and c[1:].isdigit()), key=lambda c: int(c[1:]))


def decode_index(clusters: DataFrame, all_reads: bool = False) -> DataFrame:
    """Adds ``idx``: the first index read, or all of them joined."""
    names = index_columns(clusters.columns)
    if not names:
        raise ValueError("the run has no index read")
    return clusters.withColumn("idx", F.concat(*[decode.bases(F.col(c)) for c in (names if all_reads else names[:1])]))


def to_read_pairs(clusters: DataFrame) -> DataFrame:
    """(name, b1, q1, b2, q2, sample) of runs with exactly two non-index reads."""
    names = read_columns(clusters.columns)
    if len(names) != 2:
        raise ValueError(f"read pairs need exactly 2 non-index reads, the run has {len(names)}")
    first, second = map(F.col, names)
    return clusters.select(
        "name", decode.bases(first).alias("b1"), decode.quals(first).alias("q1"),
        decode.bases(second).alias("b2"), decode.quals(second).alias("q2"), "sample",
    )


def explode_reads(clusters: DataFrame) -> DataFrame:
    """One row per cluster and read (read_no, raw), for any number of reads."""
    names = read_columns(clusters.columns)
    keep = [c for c in clusters.columns if c not in names]
    return clusters.select(*keep, F.posexplode(F.array(*names)).alias("_i", "raw")).select(
        *keep, (F.col("_i") + 1).alias("read_no"), "raw"
    )


def to_fastq(reads: DataFrame) -> DataFrame:
    """(name, read_no, idx, raw) to FASTQ fields header, bases, quals."""
    done = reads.withColumn("header", decode.fastq_header(F.col("name"), F.col("read_no"), F.col("idx")))
    return done.withColumn("bases", decode.bases(F.col("raw"))).withColumn("quals", decode.quals(F.col("raw"))).drop("raw")


def trim_pairs(pairs: DataFrame, adapter: str) -> DataFrame:
    """Pairs with both reads masked from the adapter on."""
    for bases, quals in (("b1", "q1"), ("b2", "q2")):
        own = pairs.withColumnsRenamed({bases: "bases", quals: "quals"})
        pairs = trim_adapter(own, adapter).drop("start").withColumnsRenamed({"bases": bases, "quals": quals})
    return pairs


def trim_adapter(reads: DataFrame, adapter: str, min_overlap: int = 1) -> DataFrame:
    """Masks (bases, quals) from the adapter on; adds ``start``, the first masked offset."""
    if not adapter:
        raise ValueError("an adapter must be given")
    start = F.col("start")
    return (
        reads.withColumn("start", ad.mask_start(F.col("bases"), adapter, min_overlap))
        .withColumn("bases", ad.masked_bases(F.col("bases"), start))
        .withColumn("quals", ad.masked_quals(F.col("quals"), start))
    )
