"""Reference, pair and record tables, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basewise import schemas
from basewise.functions.wire import parse_prq
from basewise.operators.reference import Reference, contig_digests, line_chunks
from basewise.session import bounded_listing, materialize, small_side

# Files of one micro-batch, so that a backlog is not one batch.
FILES_PER_BATCH = 256


def _titled_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Titles (_row, contig, assembly, species, ref_idx) and lines of bases (_file, _start, _row, _title, _bases).

    A title is a line that begins with ``>``; its first word names the contig, words
    ``AS:x`` and ``SP:x`` tell its assembly and species. Lines before the first title belong
    to none. Two contigs of one name are an error. The numbering window runs over one
    row per contig without its bases, and the carry between splits over one row per split.
    """
    lines = materialize(
        spark.read.text(path).select(
            F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_row"), F.regexp_replace("value", "\\r$", "").alias("value"),
        ),
        "fasta-lines",
    )
    place = F.struct("_file", "_start", "_row")
    is_title = F.startswith("value", F.lit(">"))
    words = F.split(F.trim(F.substring("value", 2, 2**31 - 1)), r"\s+")
    tag = lambda mark: F.nullif(F.regexp_extract("value", rf"\s{mark}:(\S+)", 1), F.lit(""))
    titles = lines.where(is_title).select(
        "_row", words[0].alias("contig"), tag("AS").alias("assembly"), tag("SP").alias("species"),
        (F.row_number().over(W.partitionBy(F.lit(0)).orderBy(place)) - 1).alias("ref_idx"),
    )
    twice = [r["contig"] for r in titles.groupBy("contig").count().where("count > 1").limit(5).collect()]
    if twice:
        raise ValueError(f"contigs named more than once: {twice}")
    # The title of a line: the last one before it in its split, or else in an earlier split.
    own = F.last(F.when(is_title, F.col("_row")), ignorenulls=True).over(W.partitionBy("_file", "_start").orderBy("_row"))
    splits = lines.groupBy("_file", "_start").agg(F.max(F.when(is_title, F.col("_row"))).alias("_last"))
    before = W.partitionBy(F.lit(0)).orderBy("_file", "_start").rowsBetween(W.unboundedPreceding, -1)
    carried = splits.select("_file", "_start", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    bases = lines.select("*", own.alias("_own")).where(~is_title).join(carried, ["_file", "_start"]).select(
        "_file", "_start", "_row", F.coalesce("_own", "_carried").alias("_title"), F.upper(F.regexp_replace("value", r"\s", "")).alias("_bases")
    )
    return titles, bases


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(ref_idx, contig, seq, length, md5), contigs numbered in file order, each one row: for small references.

    Titles are as in :func:`_titled_lines`. A genome is read by :func:`read_reference`.
    """
    titles, bases = _titled_lines(spark, path)
    at = F.struct("_file", "_start", "_row").alias("_at")
    whole = bases.select("_title", at, "_bases").groupBy("_title").agg(F.array_sort(F.collect_list(F.struct("_at", "_bases"))).alias("_l")).select(
        "_title", F.array_join(F.transform("_l", lambda x: x["_bases"]), "").alias("seq")
    )
    return titles.join(whole, F.col("_row") == F.col("_title"), "left").select(
        "ref_idx", "contig", F.coalesce("seq", F.lit("")).alias("seq")
    ).select("ref_idx", "contig", "seq", F.length("seq").alias("length"), F.md5(F.col("seq").cast("binary")).alias("md5"))


def read_reference(spark: SparkSession, path: str) -> Reference:
    """Contigs and their chunks, cut straight from the lines: no row is longer than a line or two chunks.

    A line's place in its contig is a running sum within its split, plus what earlier
    splits hold of the contig: a sum over one row per split. A line gives each chunk it
    touches its part, the chunk before it the bases that follow, the chunk after it the
    last base. Stored once.
    """
    titles, bases = _titled_lines(spark, path)
    sized = bases.where((F.length("_bases") > 0) & F.col("_title").isNotNull()).withColumn("_n", F.length("_bases").cast("long"))
    split = ["_file", "_start", "_title"]
    inside = W.partitionBy(*split).orderBy("_row").rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy("_title").orderBy("_file", "_start").rowsBetween(W.unboundedPreceding, -1)
    # Only a contig that goes on from an earlier split has a row here: one a split.
    carry = sized.groupBy(*split).agg(F.sum("_n").alias("_n")).select(*split, F.sum("_n").over(earlier).alias("_before")).where("_before > 0")
    at = F.coalesce(F.sum("_n").over(inside), F.lit(0))
    placed = sized.withColumn("_at", at).join(small_side(carry), split, "left").select(
        "_title", "_bases", "_n", (F.col("_at") + F.coalesce("_before", F.lit(0))).alias("_at")
    )
    numbers = titles.select(F.col("_row").alias("_title"), "ref_idx")
    whole = placed.join(small_side(numbers), "_title").drop("_title")
    chunks = materialize(line_chunks(whole), "reference-chunks")
    sums = contig_digests(chunks)
    contigs = titles.join(sums, "ref_idx", "left").select(
        "ref_idx", "contig", F.coalesce("length", F.lit(0)).cast("int").alias("length"), F.coalesce("md5", F.md5(F.lit("").cast("binary"))).alias("md5"),
        "assembly", "species",
    )
    return Reference(materialize(contigs, "reference-contigs"), chunks)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs written by ``write_pairs``."""
    return spark.read.schema(schemas.PAIRS).parquet(path)


def stream_pairs(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Pairs as a stream, from the earliest file, at most ``FILES_PER_BATCH`` files at once unless ``options`` say otherwise."""
    return spark.readStream.schema(schemas.PAIRS).options(**{"maxFilesPerTrigger": FILES_PER_BATCH, **options}).parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """SAM rows written by ``write_records``."""
    return spark.read.schema(schemas.SAM).parquet(path)


def stream_records(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """SAM rows as a stream, from the earliest file, batches bounded as those of :func:`stream_pairs`."""
    return spark.readStream.schema(schemas.SAM).options(**{"maxFilesPerTrigger": FILES_PER_BATCH, **options}).parquet(path)


def pairs_from_messages(messages: DataFrame, sample: str | None = None) -> DataFrame:
    """Pairs out of binary topic messages (``value``), batch or stream.

    The sample is ``sample``, or the message column of that name. ``messages`` may come
    from any source, such as a broker connector with its own options.
    """
    who = F.lit(sample) if sample is not None else F.col("sample")
    return messages.select(parse_prq(F.col("value")).alias("_p"), who.alias("sample")).select("_p.*", "sample")


def read_sam_text(spark: SparkSession, path: str) -> DataFrame:
    """Records of SAM text written by ``write_sam_text``, header lines left out."""
    from basewise.functions.cigar import cigar_parse

    with bounded_listing(spark):
        text = spark.read.schema("value string, sample string, part int").text(path)
    lines = text.where(~F.col("value").startswith("@"))
    f = F.split("value", "\t")
    tag = F.filter(F.slice(f, F.lit(12), F.greatest(F.size(f) - 11, F.lit(0))), lambda t: t != "")
    return lines.select(
        f[0].alias("name"), f[1].cast("int").alias("flag"), f[2].alias("rname"), f[3].cast("int").alias("pos"),
        f[4].cast("int").alias("mapq"), cigar_parse(f[5]).alias("cigar"), f[6].alias("rnext"),
        f[7].cast("int").alias("pnext"), f[8].cast("int").alias("tlen"), f[9].alias("seq"), f[10].alias("qual"),
        F.map_from_entries(
            F.transform(tag, lambda t: F.struct(F.split(t, ":", 3)[0].alias("key"), F.split(t, ":", 3)[2].alias("value")))
        ).alias("tags"),
        "sample",
    )
