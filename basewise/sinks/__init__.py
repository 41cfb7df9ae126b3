"""Writers: one table or text folder with a directory per sample.

``rebalance`` sizes the files: small samples share tasks, a hot sample is split over
many (AQE), instead of every task writing a file for every sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basewise.functions.cigar import cigar_format
from basewise.functions.decode import fastq_text, pair_text
from basewise.functions.tags import tags_text
from basewise.operators.ranking import ranked
from basewise.operators.reference import sam_header_lines


def _by_sample(df: DataFrame, *more: str) -> DataFrame:
    return df.hint("rebalance", *[F.col(c) for c in ("sample", *more)])


def write_pairs(pairs: DataFrame, path: str, mode: str = "errorifexists", max_records: int = 0) -> None:
    """Read pairs as Parquet, a directory per sample."""
    _by_sample(pairs).write.mode(mode).option("maxRecordsPerFile", max_records).partitionBy("sample").parquet(path)


def write_records(records: DataFrame, path: str, mode: str = "errorifexists", max_records: int = 0) -> None:
    """Aligned records as Parquet, a directory per sample."""
    _by_sample(records).write.mode(mode).option("maxRecordsPerFile", max_records).partitionBy("sample").parquet(path)


def write_fastq(reads: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(header, bases, quals, sample, read_no) as FASTQ, a directory per sample and read."""
    # The text writer ends each row with the record's last newline.
    record = F.expr("substring(_t, 1, length(_t) - 1)")
    rows = reads.select(fastq_text(F.col("header"), F.col("bases"), F.col("quals")).alias("_t"), "sample", "read_no")
    _by_sample(rows.select(record.alias("value"), "sample", "read_no"), "read_no").write.mode(mode).partitionBy(
        "sample", "read_no"
    ).text(path)


def write_pair_text(pairs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Pairs as five tab-separated fields, a directory per sample."""
    line = pair_text(*map(F.col, ("name", "b1", "q1", "b2", "q2")))
    _by_sample(pairs.select(line.alias("value"), "sample")).write.mode(mode).partitionBy("sample").text(path)


def write_toc(toc: DataFrame, path: str, mode: str = "append") -> None:
    """Table of contents; the reader writes key 0, the aligner adds key 1."""
    toc.select("key", "id", "sample").write.mode(mode).parquet(path)


def sam_lines(records: DataFrame):
    """One SAM text line per record, as a Column."""
    text = F.concat_ws(
        "\t", "name", F.col("flag").cast("string"), "rname", F.col("pos").cast("string"), F.col("mapq").cast("string"),
        F.when(F.size("cigar") == 0, F.lit("*")).otherwise(cigar_format(F.col("cigar"))), "rnext",
        F.col("pnext").cast("string"), F.col("tlen").cast("string"), "seq", "qual",
    )
    tags = tags_text(F.col("tags"))
    return F.when(F.length(tags) > 0, F.concat_ws("\t", text, tags)).otherwise(text)


def write_sam_text(records: DataFrame, contigs: DataFrame, path: str, part_records: int = 1_000_000, mode: str = "errorifexists") -> None:
    """SAM text: ``<path>/sample=<s>/part=<n>/`` holds one file with header lines on top.

    A part is the next ``part_records`` records of its sample by (name, read number),
    so no file and no task depends on how large a sample is.
    """
    numbered = ranked(records, ["sample"], [F.col("name"), F.col("read_no")], "_rn")
    head = sam_header_lines(contigs)
    text = head.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda h: h["line"]), "\n")
    )
    # The contig dictionary is one value: a scalar subquery, not a join. The first record of a part brings it along.
    line, first = sam_lines(numbered), F.expr(f"(_rn - 1) % {int(part_records)} = 0")
    lines = numbered.select(
        "sample", F.expr(f"cast((_rn - 1) div {int(part_records)} as int)").alias("part"),
        F.col("_rn").alias("_ord"), F.when(first, F.concat_ws("\n", text.scalar(), line)).otherwise(line).alias("value"),
    )
    lines.repartition("sample", "part").sortWithinPartitions("sample", "part", "_ord").select(
        "sample", "part", "value"
    ).write.mode(mode).partitionBy("sample", "part").text(path)
