"""Mate pairing and SAM rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basewise.functions import sam
from basewise.functions.cigar import CIGAR_TYPE
from basewise.functions.decode import reverse_complement
from basewise.functions.tags import sam_tags
from basewise.session import small_side

_READ = ("seq", "qual", "ref_idx", "pos", "pos_end", "strand", "nm", "score", "mapq")
_MATE = ("ref_idx", "pos", "pos_end", "strand")


def with_mates(mapped: DataFrame) -> DataFrame:
    """Each read with its mate's fields (``mate_`` prefix).

    The two reads of a name meet in a two-row window: one shuffle and one sort, where
    a self-join would shuffle the reads twice.
    """
    known = mapped.withColumn("pos_end", F.col("pos") + F.length("seq") - 1).withColumn(
        "read_no", sam.checked_read_no(F.col("read_no"))
    )
    pair = W.partitionBy("sample", "name").orderBy("read_no")
    fields = F.struct(*_MATE)
    mate = F.coalesce(F.lead(fields).over(pair), F.lag(fields).over(pair))
    return known.select("sample", "name", "read_no", *_READ, mate.alias("_m")).select(
        "sample", "name", "read_no", *_READ, *[F.col(f"_m.{c}").alias(f"mate_{c}") for c in _MATE]
    )


def with_pair_geometry(mates: DataFrame, max_insert: int = 1000) -> DataFrame:
    """Adds ``tlen`` and ``proper``."""
    c = F.col
    size = sam.insert_size(
        c("read_no"), c("ref_idx"), c("pos"), c("pos_end"), c("mate_ref_idx"), c("mate_pos"), c("mate_pos_end")
    )
    sized = mates.withColumn("tlen", size)
    return sized.withColumn(
        "proper",
        sam.proper_pair(
            c("ref_idx"), c("pos"), c("strand"), c("mate_ref_idx"), c("mate_pos"), c("mate_strand"), c("tlen"), max_insert
        ),
    )


def sam_records(
    mapped: DataFrame, contigs: DataFrame, max_insert: int = 1000, mate_info_on_unmapped: bool = False
) -> DataFrame:
    """Mapped reads as SAM rows (``schemas.SAM``).

    Reads on the other strand are stored reverse-complemented. An unmapped read
    carries no mate fields unless ``mate_info_on_unmapped`` asks for them.
    """
    c = F.col
    rows = with_pair_geometry(with_mates(mapped), max_insert)
    is_mapped, mate_mapped = c("ref_idx").isNotNull(), c("mate_ref_idx").isNotNull()
    show_mate = mate_mapped if mate_info_on_unmapped else is_mapped & mate_mapped
    # One narrow row per contig; a contig, or no contig, may hold a third of all reads.
    known = small_side(contigs.select("ref_idx", c("contig").alias("rname")))
    names, mate_names = known, known.select(c("ref_idx").alias("mate_ref_idx"), c("rname").alias("rnext"))
    named = rows.join(names, "ref_idx", "left").join(mate_names, "mate_ref_idx", "left")
    back = c("strand") == "-"
    flag = sam.sam_flag(
        c("read_no"), is_mapped, c("strand"), c("proper"), mate_mapped, c("mate_strand"), mate_info_on_unmapped
    )
    whole = F.array(F.struct(F.length("seq").alias("len"), F.lit("M").alias("op"))).cast(CIGAR_TYPE)
    return named.select(
        "name",
        flag.alias("flag"),
        F.coalesce("rname", F.lit("*")).alias("rname"),
        F.coalesce("pos", F.lit(0)).cast("int").alias("pos"),
        F.coalesce("mapq", F.lit(0)).cast("int").alias("mapq"),
        F.when(is_mapped, whole).otherwise(F.array().cast(CIGAR_TYPE)).alias("cigar"),
        F.when(show_mate, c("rnext")).otherwise("*").alias("rnext"),
        F.when(show_mate, c("mate_pos")).otherwise(0).cast("int").alias("pnext"),
        F.coalesce("tlen", F.lit(0)).cast("int").alias("tlen"),
        F.when(back, reverse_complement(c("seq"))).otherwise(c("seq")).alias("seq"),
        F.when(back, F.reverse("qual")).otherwise(c("qual")).alias("qual"),
        F.when(is_mapped, sam_tags(c("nm"), c("score"))).otherwise(F.create_map().cast("map<string,string>")).alias("tags"),
        "sample",
        c("read_no").cast("int").alias("read_no"),
        F.coalesce("ref_idx", F.lit(-1)).cast("int").alias("ref_idx"),
        F.coalesce("pos_end", F.lit(0)).cast("int").alias("pos_end"),
    )


def contig_index(records: DataFrame, contigs: DataFrame) -> DataFrame:
    """``ref_idx`` of each record's contig name, -1 for ``*``."""
    names = small_side(contigs.select(F.col("contig").alias("rname"), F.col("ref_idx").alias("_i")))
    return records.drop("ref_idx").join(names, "rname", "left").withColumn(
        "ref_idx", F.coalesce("_i", F.lit(-1)).cast("int")
    ).drop("_i")
