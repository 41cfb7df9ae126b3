"""Reference contigs as rows of fixed-size chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basewise.functions.decode import reverse_complement
from basewise.session import materialize

# Own bases per chunk. A chunk row also holds the next chunk's bases and the base
# before it, so any stretch of up to CHUNK bases lies in one row.
CHUNK = 1024
# Letters of the stretches that words are cut from: ``substring`` scans from the start.
STRETCH = 32


def contig_chunks(contigs: DataFrame) -> DataFrame:
    """(ref_idx, chunk, own, bases): base p of a contig is character p - chunk*CHUNK + 1.

    One linear pass cuts the sequence; positional ``substring`` calls on a whole
    chromosome would scan it from the start each time. Character 1 of the first
    chunk is ``^``: there is no base before the contig.
    """
    pieces = F.regexp_extract_all("seq", F.lit(f".{{1,{CHUNK}}}"), 0)
    cut = contigs.select("ref_idx", pieces.alias("_p"))

    def row(x: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit("^")).otherwise(F.right(F.get("_p", i - 1), F.lit(1)))
        after = F.coalesce(F.get("_p", i + 1), F.lit(""))
        return F.struct(
            i.cast("int").alias("chunk"), F.length(x).cast("int").alias("own"), F.concat(before, x, after).alias("bases")
        )

    return cut.select("ref_idx", F.explode(F.transform("_p", row)).alias("_c")).select("ref_idx", "_c.*")


@dataclass(frozen=True)
class Reference:
    """A reference without whole-contig rows: ``contigs`` (ref_idx, contig, length, md5, assembly, species) and ``chunks``."""

    contigs: DataFrame
    chunks: DataFrame


def contigs_of(reference: DataFrame | Reference | ReferenceIndex) -> DataFrame:
    """(ref_idx, contig and more) of a contig table, a reference or an index."""
    return reference if isinstance(reference, DataFrame) else reference.contigs


def chunks_of(reference: DataFrame | Reference | ReferenceIndex) -> DataFrame:
    """The chunk rows of a contig table, a reference or an index."""
    return contig_chunks(reference) if isinstance(reference, DataFrame) else reference.chunks


def line_chunks(lines: DataFrame) -> DataFrame:
    """Chunk rows as those of :func:`contig_chunks`, from pieces of contigs (ref_idx, _at, _n, _bases; _at counts from 0)."""
    first, last = F.floor(F.col("_at") / CHUNK), F.floor((F.col("_at") + F.col("_n") - 1) / CHUNK)
    each = lines.select("*", F.explode(F.sequence(first, last)).alias("_c"))
    start = F.greatest(F.lit(0).cast("long"), F.col("_c") * CHUNK - F.col("_at"))
    stop = F.least(F.col("_n"), (F.col("_c") + 1) * CHUNK - F.col("_at"))
    own = each.select(
        "ref_idx", "_c", (F.col("_at") + start).alias("_p"), F.substring("_bases", (start + 1).cast("int"), (stop - start).cast("int")).alias("_s")
    )
    part = F.struct("_p", "_s")
    # A piece belongs to its chunk, follows the chunk before it, and its last base may precede the next.
    ends = F.pmod(F.col("_p") + F.length("_s"), F.lit(CHUNK)) == 0
    to = F.array(
        F.struct(F.col("_c").alias("chunk"), F.lit(1).alias("_kind"), part.alias("_part")),
        F.struct((F.col("_c") - 1).alias("chunk"), F.lit(2).alias("_kind"), part.alias("_part")),
        F.struct((F.col("_c") + 1).alias("chunk"), F.lit(0).alias("_kind"), F.struct(F.col("_p"), F.right("_s", F.lit(1)).alias("_s")).alias("_part")),
    )
    rows = own.select("ref_idx", F.explode(F.filter(to, lambda x: (x["_kind"] != 0) | ends)).alias("_r")).select("ref_idx", "_r.*").where("chunk >= 0")
    held = rows.groupBy("ref_idx", "chunk").agg(F.array_sort(F.collect_list(F.struct("_kind", "_part"))).alias("_l"))

    def text(kind: int) -> Column:
        return F.array_join(F.transform(F.filter("_l", lambda x: x["_kind"] == kind), lambda x: x["_part"]["_s"]), "")

    before = F.when(F.col("chunk") == 0, F.lit("^")).otherwise(text(0))
    # A chunk without bases of its own is none: the row after a contig's last.
    return held.select("ref_idx", F.col("chunk").cast("int").alias("chunk"), before.alias("_b"), text(1).alias("_o"), text(2).alias("_a")).where("_o <> ''").select(
        "ref_idx", "chunk", F.length("_o").cast("int").alias("own"), F.concat("_b", "_o", "_a").alias("bases")
    )


def contig_digests(chunks: DataFrame) -> DataFrame:
    """(ref_idx, length, md5) of each contig's bases, chunk by chunk: a task holds one chunk of its contig at a time."""
    ordered = chunks.select("ref_idx", "chunk", F.substring("bases", F.lit(2), F.col("own")).alias("_own")).repartition("ref_idx").sortWithinPartitions("ref_idx", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contig, digest, length = None, None, 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"ref_idx": pa.array([contig], pa.int32()), "length": pa.array([length], pa.int64()), "md5": [digest.hexdigest()]})

        for batch in batches:
            for ref_idx, own in zip(batch.column("ref_idx").to_pylist(), batch.column("_own").to_pylist()):
                if ref_idx != contig:
                    if contig is not None:
                        yield done()
                    contig, digest, length = ref_idx, hashlib.md5(), 0
                digest.update(own.encode())
                length += len(own)
        if contig is not None:
            yield done()

    return ordered.withColumn("ref_idx", F.col("ref_idx").cast("int")).mapInArrow(run, "ref_idx int, length long, md5 string")


def chunk_of(pos: Column) -> Column:
    """Chunk that holds 1-based contig position ``pos``."""
    return F.floor((pos - 1) / CHUNK).cast("int")


def chunk_bases(bases: Column, chunk: Column, pos: Column, length: Column) -> Column:
    """``length`` reference bases from ``pos`` out of the row of ``chunk_of(pos)``."""
    return F.substring(bases, (pos - chunk * CHUNK + 1).cast("int"), length.cast("int"))


def contig_words(chunks: DataFrame, k: int) -> DataFrame:
    """(word, prev, next, ref_idx, p): each k-base word free of ``N`` with the bases around it, empty beyond the end."""
    first = F.explode(F.sequence(F.lit(0), F.col("own") - 1, F.lit(STRETCH)))
    stretch = F.substring("bases", F.col("_s") + 1, F.lit(STRETCH + k + 1))
    pieces = chunks.select("ref_idx", "chunk", "own", "bases", first.alias("_s")).select(
        "ref_idx", (F.col("chunk") * CHUNK + F.col("_s")).alias("_at"), stretch.alias("_t"),
        F.least(F.lit(STRETCH), F.col("own") - F.col("_s")).alias("_n"),
    )
    at = pieces.select("ref_idx", "_at", "_t", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_o"))
    return at.select(
        F.substring("_t", F.col("_o") + 1, F.lit(k)).alias("word"),
        F.substring("_t", F.col("_o"), F.lit(1)).alias("prev"),
        F.substring("_t", F.col("_o") + k + 1, F.lit(1)).alias("next"),
        "ref_idx",
        (F.col("_at") + F.col("_o")).alias("p"),
    ).where((F.length("word") == k) & ~F.contains("word", F.lit("N")))


def stranded_words(words: DataFrame) -> DataFrame:
    """(word, before, strand, ref_idx, p): words of both strands, read in their own direction."""
    both = F.array(
        F.struct(F.lit("+").alias("strand"), F.col("word"), F.col("prev").alias("before")),
        F.struct(F.lit("-").alias("strand"), reverse_complement(F.col("word")).alias("word"), reverse_complement(F.col("next")).alias("before")),
    )
    return words.select("ref_idx", "p", F.explode(both).alias("_w")).select("_w.*", "ref_idx", "p")


@dataclass(frozen=True)
class ReferenceIndex:
    """What mapping needs of a reference: words of ``k`` bases of both strands, chunks, and ``contigs`` (ref_idx, contig, length)."""

    k: int
    contigs: DataFrame
    chunks: DataFrame
    words: DataFrame


def reference_index(reference: DataFrame | Reference, k: int, store: bool = True) -> ReferenceIndex:
    """The index of a reference, or of a contig table. With ``store`` it is written once to the shared folder, for many uses.

    Chunks are dealt out before words are cut, so a chromosome is not one task.
    """
    known, chunks = contig_lengths(contigs_of(reference)), chunks_of(reference)
    if not store:
        return ReferenceIndex(k, known, chunks, stranded_words(contig_words(chunks, k)))
    if isinstance(reference, DataFrame):
        chunks = materialize(chunks.repartition("ref_idx", "chunk"), "reference-chunks")
    words = materialize(stranded_words(contig_words(chunks, k)), "reference-words")
    return ReferenceIndex(k, materialize(known, "reference-contigs"), chunks, words)


def contig_lengths(contigs: DataFrame) -> DataFrame:
    """(ref_idx, contig, length)."""
    return contigs.select("ref_idx", "contig", F.col("length") if "length" in contigs.columns else F.length("seq").alias("length"))


def contig_md5(contigs: DataFrame) -> DataFrame:
    """(ref_idx, contig, md5) of the upper-case bases."""
    digest = F.col("md5") if "md5" in contigs.columns and "seq" not in contigs.columns else F.md5(F.upper("seq").cast("binary"))
    return contigs.select("ref_idx", "contig", digest.alias("md5"))


def sam_header_lines(contigs: DataFrame, program: str = "basewise") -> DataFrame:
    """(ord, line): one ``@SQ`` line per contig, then one ``@PG`` line. Order is left unset.

    AS, SP and M5 appear when the contig table has the column and a value.
    """

    def tag(mark: str, c: str) -> Column:
        return F.concat(F.lit(f"\t{mark}:"), F.col(c)) if c in contigs.columns else F.lit(None).cast("string")

    length = F.col("length") if "length" in contigs.columns else F.length("seq")
    line = F.concat_ws(
        "", F.lit("@SQ\tSN:"), "contig", F.lit("\tLN:"), length.cast("string"),
        tag("AS", "assembly"), tag("SP", "species"), tag("M5", "md5"),
    )
    last = contigs.sparkSession.createDataFrame([(2**31 - 1, f"@PG\tID:{program}\tPN:{program}")], "ord int, line string")
    return contigs.select(F.col("ref_idx").cast("int").alias("ord"), line.alias("line")).unionByName(last)
