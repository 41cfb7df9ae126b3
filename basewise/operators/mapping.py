"""Read-to-reference mapping as a distributed seed join (ungapped).

A read maps where it shares at least one k-base word with the reference and has
the fewest mismatches. The steps, each an ordinary join or aggregation:

1. distinct read sequences, stored under a number, so that copies are mapped once;
2. reads cut into words, equi-joined with the words of both reference strands (the
   reads, many times the reference, are cut in one direction only);
3. candidates (numbers only) joined with their bases and their reference chunk, and
   compared a batch at a time: mismatches and votes;
4. best two scores per sequence, hence position and mapping quality;
5. the result joined back to every read.

No word, candidate or read is dropped for being frequent. What keeps frequent
words affordable is that a hit is emitted only where a run of equal bases begins
(``prev`` differs), not once per word of the run; the votes are recomputed when
the candidate is verified. The word and chunk joins carry no hint: Spark broadcasts
a small reference by size, and splits hot words of a large one (AQE skew join).

The word length ``k`` is the user's choice, never the data's. Chance hits of a read
grow as reference length / 4^k: 12 suits references of up to some megabases and short
reads; genomes need about 19 (the default of the programs).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basewise.functions.decode import reverse_complement
from basewise.operators.reference import CHUNK, Reference, ReferenceIndex, chunk_bases, chunk_of, reference_index
from basewise.session import materialize, small_side

MISMATCH_PENALTY = 5
MAX_MAPQ = 60


def explode_pairs(pairs: DataFrame) -> DataFrame:
    """Two rows per pair: (name, sample, read_no, seq, qual)."""
    both = F.array(
        F.struct(F.lit(1).alias("read_no"), F.col("b1").alias("seq"), F.col("q1").alias("qual")),
        F.struct(F.lit(2).alias("read_no"), F.col("b2").alias("seq"), F.col("q2").alias("qual")),
    )
    return pairs.select("name", "sample", F.explode(both).alias("_r")).select("name", "sample", "_r.*")


def count_kmers(seqs: DataFrame, k: int) -> DataFrame:
    """(kmer, n) over every word of column ``seq`` free of ``N``."""
    spots = seqs.where(F.length("seq") >= k).select("seq", F.explode(F.sequence(F.lit(1), F.length("seq") - (k - 1))).alias("_i"))
    words = spots.select(F.substring("seq", F.col("_i"), F.lit(k)).alias("kmer"))
    return words.where(~F.contains("kmer", F.lit("N"))).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def enumerate_kmers(spark, k: int) -> DataFrame:
    """All 4^k words in A < C < G < T order: a number written in base 4."""
    digits = F.lpad(F.conv(F.col("id").cast("string"), 10, 4), k, "0")
    return spark.range(4**k).select("id", F.translate(digits, "0123", "ACGT").alias("kmer"))


def kmer_spectrum(seqs: DataFrame, k: int) -> DataFrame:
    """Count of every possible word, zeros kept."""
    return enumerate_kmers(seqs.sparkSession, k).join(count_kmers(seqs, k), "kmer", "left").select(
        "kmer", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def _read_words(seqs: DataFrame, k: int) -> DataFrame:
    """(read, len, i, word, prev) of distinct reads, as they are."""
    spots = F.explode(F.sequence(F.lit(1), F.col("len") - (k - 1)))
    return (
        seqs.select("read", F.length("seq").alias("len"), "seq")
        .where(F.col("len") >= k)
        .select("read", "len", "seq", spots.alias("i"))
        .select(
            "read", "len", "i",
            F.substring("seq", F.col("i"), F.lit(k)).alias("word"),
            F.when(F.col("i") > 1, F.substring("seq", F.col("i") - 1, F.lit(1))).otherwise("$").alias("prev"),
        )
        .where(~F.contains("word", F.lit("N")))
    )


def seed_candidates(seqs: DataFrame, index: ReferenceIndex) -> DataFrame:
    """Distinct (read, len, strand, ref_idx, pos) of numbered ``seqs`` (read, seq) that share a word and fit the contig."""
    on_other = F.col("p") - F.col("len") + F.col("i") + (index.k - 1)
    hits = (
        _read_words(seqs, index.k)
        .join(index.words, "word")
        # "N" never equals anything, not even another "N".
        .where((F.col("prev") != F.col("before")) | (F.col("prev") == "N"))
        .select("read", "len", "strand", "ref_idx", F.when(F.col("strand") == "-", on_other).otherwise(F.col("p") - F.col("i") + 1).alias("pos"))
    )
    # One narrow row per contig; a contig may hold a third of all hits.
    lengths = small_side(index.contigs.select("ref_idx", "length"))
    fits = hits.join(lengths, "ref_idx").where((F.col("pos") >= 1) & (F.col("pos") + F.col("len") - 1 <= F.col("length")))
    return fits.select("read", "len", "strand", "ref_idx", "pos").distinct()


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All letters of a string column in a row, and where each string begins and the last ends."""
    binary = column.cast(pa.large_binary())
    bounds = np.frombuffer(binary.buffers()[1], dtype=np.int64)[binary.offset : binary.offset + len(binary) + 1]
    return np.frombuffer(binary.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def compare(reads: pa.Array, references: pa.Array, counted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mismatches among the first ``counted`` letters, and equal words of ``k`` letters, of strings of equal length.

    ``N`` differs from every letter. The strings must not be empty.
    """
    own, bounds = _letters(reads)
    differs = (own != _letters(references)[0]) | (own == ord("N"))
    starts, sizes = bounds[:-1], np.diff(bounds)
    place = np.arange(len(own)) - np.repeat(starts, sizes)
    nm = np.add.reduceat((differs & (place < np.repeat(counted, sizes))).astype(np.int32), starts)
    before = np.concatenate([[0], np.cumsum(differs)])
    whole = np.zeros(len(own), dtype=np.int32)
    if len(own) >= k:
        whole[: len(own) - k + 1] = before[k:] == before[: len(own) - k + 1]
    whole[place + k > np.repeat(sizes, sizes)] = 0
    return nm.astype(np.int32), np.add.reduceat(whole, starts).astype(np.int32)


_HIT = ("read", "len", "strand", "ref_idx", "pos")


def verify(candidates: DataFrame, seqs: DataFrame, index: ReferenceIndex, long_reads: bool = True) -> DataFrame:
    """Candidates with nm, votes and score, counted against the reference bases.

    A read longer than a chunk is compared in pieces that overlap by ``k - 1`` letters,
    so that mismatches and words of the pieces add up; ``long_reads`` may be off where
    no read is that long.
    """
    k = index.k
    step = CHUNK - (k - 1)
    if long_reads:
        last = F.greatest(F.lit(0), F.floor((F.col("len") - k) / step)).cast("int")
        keyed = candidates.select("*", last.alias("_last")).select("*", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("_part"))
    else:
        keyed = candidates.select("*", F.lit(0).alias("_last"), F.lit(0).alias("_part"))
    at = F.col("_part") * step
    start, size = F.col("pos") + at, F.least(F.lit(CHUNK), F.col("len") - at)
    oriented = F.when(F.col("strand") == "-", reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    joined = (
        keyed.join(seqs, "read")
        .withColumn("chunk", chunk_of(start))
        .join(index.chunks.select("ref_idx", "chunk", "bases"), ["ref_idx", "chunk"])
        .select(
            *_HIT, F.when(F.col("_part") == F.col("_last"), CHUNK).otherwise(step).alias("_counted"),
            (F.substring(oriented, at + 1, size) if long_reads else oriented).alias("_read"),
            chunk_bases(F.col("bases"), F.col("chunk"), start, size).alias("_reference"),
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nm, votes = compare(batch.column("_read"), batch.column("_reference"), batch.column("_counted").to_numpy(), k)
                kept = [batch.column(c) for c in _HIT]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(nm), pa.array(votes)], names=[*_HIT, "nm", "votes"])

    schema = "read long, len int, strand string, ref_idx int, pos int, nm int, votes int"
    compared = joined.withColumn("pos", F.col("pos").cast("int")).mapInArrow(run, schema)
    if long_reads:
        compared = compared.groupBy(*_HIT).agg(F.sum("nm").cast("int").alias("nm"), F.sum("votes").cast("int").alias("votes"))
    return compared.withColumn("score", F.col("len") - MISMATCH_PENALTY * F.col("nm"))


def best_hits(scored: DataFrame) -> DataFrame:
    """Best candidate per ``read`` with its mapping quality.

    Order: score, votes (both falling), contig, position, strand. The first
    aggregation leaves one row per distinct score, at most the read length of them,
    so a read of a high-copy repeat collects no more than any other.
    """
    rank = F.struct(
        (-F.col("votes")).alias("nvotes"), "ref_idx", "pos", "strand", "nm",
    )
    # "+" sorts before "-".
    per_score = scored.groupBy("read", "score").agg(F.min(rank).alias("hit"), F.count(F.lit(1)).alias("n"))
    top = F.slice(F.sort_array(F.collect_list(F.struct("score", "n", "hit")), asc=False), 1, 2)
    two = per_score.groupBy("read").agg(top.alias("_t"))
    first, second = F.col("_t")[0], F.get("_t", F.lit(1))
    rival = F.when(first["n"] > 1, first["score"]).otherwise(second["score"])
    gap = f"({MAX_MAPQ} * (score - _rival)) div score"
    return (
        two.select(
            "read", first["hit"]["ref_idx"].alias("ref_idx"), first["hit"]["pos"].alias("pos"),
            first["hit"]["strand"].alias("strand"), first["hit"]["nm"].alias("nm"),
            (-first["hit"]["nvotes"]).alias("votes"), first["score"].alias("score"), rival.alias("_rival"),
        )
        .withColumn(
            "mapq",
            F.when(F.col("score") <= 0, 0)
            .when(F.col("_rival").isNull(), MAX_MAPQ)
            .otherwise(F.least(F.lit(MAX_MAPQ), F.greatest(F.lit(0), F.expr(gap))))
            .cast("int"),
        )
        .drop("_rival")
    )


def map_sequences(seqs: DataFrame, reference: DataFrame | Reference | ReferenceIndex, k: int = 12, min_score: int = 10) -> DataFrame:
    """Mapped distinct sequences: (seq, ref_idx, pos, strand, nm, votes, score, mapq).

    ``reference`` is a contig table, or a stored index, whose word length holds then.
    Candidates without a positive score change nothing: they cannot be the best of a
    mapped read, and as a rival they leave the quality at its maximum. They are left
    out before the aggregation.
    """
    if min_score < 1:
        raise ValueError("min_score must be at least 1")
    index = reference if isinstance(reference, ReferenceIndex) else reference_index(reference, k, store=False)
    # Stored, so that a number means the same sequence wherever it is used.
    numbered = materialize(seqs.select("seq", F.monotonically_increasing_id().alias("read")), "distinct-reads")
    long_reads = not numbered.where(F.length("seq") > CHUNK).isEmpty()
    scored = verify(seed_candidates(numbered, index), numbered, index, long_reads).where(F.col("score") > 0)
    best = best_hits(scored).where(F.col("score") >= min_score)
    return best.join(numbered, "read").select("seq", *[c for c in best.columns if c != "read"])


def map_reads(reads: DataFrame, reference: DataFrame | Reference | ReferenceIndex, k: int = 12, min_score: int = 10) -> DataFrame:
    """``reads`` (with column ``seq``) plus ref_idx, pos, strand, nm, votes, score, mapq.

    Unmapped reads keep their row with NULLs and quality 0. ``reads`` is scanned twice,
    so pass a stored table. ``reference`` is as in :func:`map_sequences`.

    The result per sequence is written to the shared folder first. The join back is
    then between two scans, each shuffled for this join alone, which is what Spark
    needs to split a sequence that a third of the reads share.
    """
    mapped = materialize(map_sequences(reads.select("seq").distinct(), reference, k, min_score), "mapped")
    return reads.join(mapped, "seq", "left").select(
        *[F.col(c) for c in reads.columns],
        "ref_idx", "pos", "strand", "nm", "votes", "score", F.coalesce("mapq", F.lit(0)).alias("mapq"),
    )


def map_with(reads: DataFrame, aligner: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Hook for a user's aligner: Arrow batches of reads in, Arrow batches of rows out.

    The batch size is the session's ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """
    return reads.mapInArrow(aligner, schema)
