"""Sequencing tables derived from the driver's test tables.

Every cluster of these tables is an order, every barcode a nation, every contig a
region, so their size follows the input. The same definitions, as DuckDB text, are
in :mod:`basewise.oracle`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewise.functions import decode
from basewise.operators.alignment import sam_records
from basewise.operators.demux import demux_assign
from basewise.operators.layout import CycleRange
from basewise.operators.mapping import explode_pairs, map_reads
from basewise.session import materialize

# The run these fixtures describe: read 1, one index read, read 2.
READS = [CycleRange(1, False, 1, 36), CycleRange(2, True, 37, 44), CycleRange(3, False, 45, 80)]
INSTRUMENT, RUN, FLOWCELL = "BW01", "7", "FCX1"

_HEX = "'0123456789abcdef','ACGTACGTACGTACGT'"

_CONTIGS = f"""
select cast(r_regionkey as int) as ref_idx, r_name as contig,
  array_join(transform(sequence(0,63), i -> translate(md5(concat(
    case when i % 16 in (7,8) then 'repeat' else r_name end,'-',cast(i as string))),{_HEX})),'') as seq
from {{region}}
"""

_SHEET = f"""
select cast(n_nationkey % 2 + 1 as int) as lane, concat('S', cast(n_nationkey % 15 as varchar(10))) as sample,
  translate(substr(md5(n_name),1,8),{_HEX}) as idx
from {{nation}}
"""

_CLUSTERS = f"""
with o as (
  select o_orderkey as cid, cast(o_orderkey % 2 + 1 as int) as lane,
    cast(1101 + (o_orderkey % 8 - o_orderkey % 2) / 2 as int) as tile,
    case when o_orderstatus = 'P' then 0 else 1 end as pf,
    cast((o_orderkey % 12) * 2 + o_orderkey % 2 as int) as nk, cast(o_custkey % 5 as int) as rk,
    cast((o_orderkey * 37) % 1900 + 1 as int) as pos1, cast(80 + o_orderkey % 40 as int) as tlen
  from {{orders}}),
j as (
  select o.*, translate(substr(md5(n.n_name),1,8),{_HEX}) as tidx, k.contig as tcontig, k.seq
  from o join {{nation}} n on n.n_nationkey = o.nk join {{contigs}} k on k.ref_idx = o.rk)
select cid, lane, tile, pf, tcontig, pos1, tlen, tidx,
  case when cid % 11 = 0 then translate(substr(md5(cast(cid as varchar(20))),1,8),{_HEX})
       when cid % 7 = 0 then concat('NN', substr(tidx,3,6))
       when cid % 5 = 0 then concat(substr(tidx,1,7),'N') else tidx end as idx_obs,
  case when cid % 13 = 0 then substr(translate(concat(md5(cast(cid as varchar(20))), md5(concat('x', cast(cid as varchar(20))))),{_HEX}),1,36)
       else substr(seq,pos1,36) end as r1,
  case when cid % 169 = 0 then substr(translate(concat(md5(concat('y', cast(cid as varchar(20)))), md5(concat('z', cast(cid as varchar(20))))),{_HEX}),1,36)
       when cid % 17 = 0 then concat(substr(m2,1,17), translate(substr(m2,18,2),'ACGT','CATG'), substr(m2,20,17))
       else m2 end as r2
from (select j.*, reverse(translate(substr(seq,pos1+tlen-36,36),'ACGT','TGCA')) as m2 from j)
"""


def _call_bytes(cid: pd.Series, letters: pd.Series) -> pd.Series:
    """One byte per letter: the base in bits 0-1, a made-up quality above, 0 for no-calls."""
    width = READS[-1].last
    text = np.frombuffer("".join(letters).encode("ascii"), dtype=np.uint8).reshape(-1, width)
    quality = (cid.to_numpy()[:, None] * 7 + np.arange(1, width + 1) * 13) % 41
    base = np.searchsorted(np.frombuffer(b"ACGNT", dtype=np.uint8), text)
    code = np.array([0, 1, 2, 0, 3])[base]
    raw = np.where((text == ord("N")) | (quality == 0), 0, 4 * quality + code).astype(np.uint8).tobytes()
    return pd.Series([raw[at : at + width] for at in range(0, len(raw), width)])


# The columns used here; an explicit schema saves a schema-inference job per read.
_TABLES = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string",
    "nation": "n_nationkey int, n_name string",
    "region": "r_regionkey int, r_name string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer splits than there are cores, dealt out over all of them.

    The test tables are one small file each, while every row grows into kilobytes of
    calls and reads. A table with enough splits is left alone: no shuffle at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5 contigs x 2,048 bases with shared repeats."""
    return spark.sql(_CONTIGS, region=table(spark, sf_dir, "region"))


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 barcodes, 15 samples, some in both lanes."""
    return spark.sql(_SHEET, nation=table(spark, sf_dir, "nation"))


def clusters_of(orders: DataFrame, sf_dir: str) -> DataFrame:
    """One cluster per row of ``orders``, which may be a stream."""
    spark = orders.sparkSession
    return spark.sql(
        _CLUSTERS, orders=orders, nation=table(spark, sf_dir, "nation"), contigs=contigs(spark, sf_dir)
    )


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cluster per order, passing or not, with its origin and its letters."""
    return clusters_of(spread(table(spark, sf_dir, "orders")), sf_dir)


def with_position(df: DataFrame) -> DataFrame:
    """Adds the cluster's number in its tile and its coordinates."""
    n = F.expr("cid div 8")
    return df.select(
        "*", n.alias("cluster"), (n % 1000 * 10 + 1000).cast("int").alias("x"),
        (F.expr("cid div 8000") * 10 + 1000).cast("int").alias("y"),
    )


def calls(df: DataFrame) -> DataFrame:
    """Adds ``calls``: the cluster's raw bytes of all 80 cycles."""
    call_bytes = F.pandas_udf(_call_bytes, "binary")
    return df.withColumn("calls", call_bytes(F.col("cid"), F.concat("r1", "idx_obs", "r2")))


def raw_of(df: DataFrame) -> DataFrame:
    """Passing clusters of a cluster table with raw reads (r1, i1, r2) and their name."""
    sliced = calls(with_position(df).where(F.col("pf") == 1)).select(
        "cid", "lane", "tile", "cluster", "x", "y",
        F.substring("calls", 1, 36).alias("r1"), F.substring("calls", 37, 8).alias("i1"), F.substring("calls", 45, 36).alias("r2"),
    )
    return sliced.withColumn("name", name_column())


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_of(clusters(spark, sf_dir))


def name_column():
    return decode.read_name(
        F.lit(INSTRUMENT), F.lit(RUN), F.lit(FLOWCELL), *map(F.col, ("lane", "tile", "x", "y"))
    )


def pairs_of(df: DataFrame, sf_dir: str) -> DataFrame:
    """Decoded read pairs with their sample."""
    spark = df.sparkSession
    keyed = raw_of(df).withColumn("idx", decode.bases(F.col("i1")))
    assigned = demux_assign(keyed, sheet(spark, sf_dir))
    return assigned.select(
        "name",
        decode.bases(F.col("r1")).alias("b1"), decode.quals(F.col("r1")).alias("q1"),
        decode.bases(F.col("r2")).alias("b2"), decode.quals(F.col("r2")).alias("q2"),
        "sample",
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_of(clusters(spark, sf_dir), sf_dir)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows per pair."""
    return explode_pairs(pairs(spark, sf_dir))


def stored_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads of a stored pair table: what the aligner finds when the reader is done."""
    return explode_pairs(materialize(pairs(spark, sf_dir), "pairs"))


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_reads(stored_reads(spark, sf_dir), contigs(spark, sf_dir))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SAM rows of every read."""
    return sam_records(mapped(spark, sf_dir), contigs(spark, sf_dir))
