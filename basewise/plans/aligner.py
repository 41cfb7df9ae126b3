"""Read pairs to aligned records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewise.operators.alignment import sam_records
from basewise.operators.mapping import explode_pairs, map_reads
from basewise.operators.reference import Reference, ReferenceIndex, contigs_of, reference_index
from basewise.operators.routing import drop_eos
from basewise.sinks import write_records, write_toc
from basewise.sources.tables import read_pairs


def align_pairs(pairs: DataFrame, reference: DataFrame | Reference | ReferenceIndex, k: int = 12, min_score: int = 10, max_insert: int = 1000) -> DataFrame:
    """SAM rows of every pair; sentinel pairs are left out. ``reference`` is as in :func:`map_sequences`."""
    return sam_records(map_reads(explode_pairs(drop_eos(pairs)), reference, k, min_score), contigs_of(reference), max_insert)


def republish_toc(toc: DataFrame) -> DataFrame:
    """The reader's contents (key 0) under the aligner's key 1."""
    return toc.where(F.col("key") == 0).select(F.lit(1).alias("key"), "id", "sample")


def align_run(spark: SparkSession, data: str, reference: DataFrame | Reference, k: int = 12) -> None:
    """The aligner program over the reader's output folder, with words of ``k`` bases."""
    toc = spark.read.schema("key int, id int, sample string").parquet(f"{data}/toc")
    write_toc(republish_toc(toc), f"{data}/toc")
    write_records(align_pairs(read_pairs(spark, f"{data}/pairs"), reference_index(reference, k)), f"{data}/records", mode="append")
