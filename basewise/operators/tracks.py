"""Coverage and mismatch tracks per reference position.

Alignments become intervals, cut at the edges of fixed reference bins. Coverage is
a running sum of +1/-1 events inside a bin, so a read adds two rows instead of one
per base, and no window is wider than a bin. Events are summed per position before
they are shuffled by bin: a position covered by a third of all reads costs a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basewise.functions.cigar import REF_OPS, placed_elements
from basewise.operators.reference import CHUNK, Reference, chunk_bases, chunk_of, chunks_of

# Elements that compare a read base with a reference base.
COMPARED_OPS = "M=X"


def _pieces(records: DataFrame, ops: str, *keep: str) -> DataFrame:
    """CIGAR elements of mapped records cut at chunk edges.

    One row per piece: (ref_idx, chunk, ref_start, read_start, len).
    """
    placed = F.filter(
        placed_elements(F.col("pos"), F.col("cigar")), lambda e: F.instr(F.lit(ops), e["op"]) > 0
    )
    elements = records.where(F.col("ref_idx") >= 0).select("ref_idx", *keep, F.explode(placed).alias("_e"))
    last = F.col("_e.ref_start") + F.col("_e.len") - 1
    cut = elements.where(F.col("_e.len") > 0).select(
        "*", F.explode(F.sequence(chunk_of(F.col("_e.ref_start")), chunk_of(last))).alias("chunk")
    )
    start = F.greatest(F.col("_e.ref_start"), F.col("chunk") * CHUNK + 1)
    end = F.least(last, (F.col("chunk") + 1) * CHUNK)
    return cut.select(
        "ref_idx", *keep, "chunk", start.alias("ref_start"),
        (F.col("_e.read_start") + start - F.col("_e.ref_start")).alias("read_start"), (end - start + 1).alias("len"),
    )


def coverage(records: DataFrame) -> DataFrame:
    """(ref_idx, pos, n) for every covered position; deletions and skips count."""
    pieces = _pieces(records, REF_OPS)
    events = F.array(
        F.struct(F.col("ref_start").alias("pos"), F.lit(1).alias("d")),
        F.struct((F.col("ref_start") + F.col("len")).alias("pos"), F.lit(-1).alias("d")),
    )
    deltas = (
        pieces.select("ref_idx", "chunk", F.explode(events).alias("_v"))
        .groupBy("ref_idx", "chunk", F.col("_v.pos").alias("pos"))
        .agg(F.sum("_v.d").alias("d"))
    )
    bin_order = W.partitionBy("ref_idx", "chunk").orderBy("pos")
    depth = deltas.select(
        "ref_idx", "pos", F.sum("d").over(bin_order.rowsBetween(W.unboundedPreceding, 0)).alias("n"), F.lead("pos").over(bin_order).alias("_next")
    ).where(F.col("n") > 0)
    # The last event of a bin ends every interval, so "_next" exists where n > 0.
    return depth.select("ref_idx", F.explode(F.sequence(F.col("pos"), F.col("_next") - 1)).alias("pos"), "n")


def _differing(read: Column, reference: Column, start: Column) -> Column:
    """Reference positions, counted from ``start``, where two strings differ."""
    marks = F.zip_with(F.split(read, ""), F.split(reference, ""), lambda a, b: a != b)
    return F.filter(F.transform(marks, lambda m, i: F.when(m, start + i)), lambda i: i.isNotNull())


def mismatch_track(records: DataFrame, reference: DataFrame | Reference) -> DataFrame:
    """(ref_idx, pos, n): reads whose base differs from the reference at ``pos``.

    Only differing positions are exploded. Pieces without a difference are dropped
    by one string comparison.
    """
    pieces = _pieces(records, COMPARED_OPS, "seq").select(
        "ref_idx", "chunk", "ref_start", "len", F.substring("seq", F.col("read_start"), F.col("len")).alias("_read")
    )
    joined = pieces.join(chunks_of(reference).select("ref_idx", "chunk", "bases"), ["ref_idx", "chunk"]).select(
        "ref_idx", "ref_start", "_read", chunk_bases(F.col("bases"), F.col("chunk"), F.col("ref_start"), F.col("len")).alias("_ref")
    )
    return (
        joined.where(F.col("_read") != F.col("_ref"))
        .select("ref_idx", F.explode(_differing(F.col("_read"), F.col("_ref"), F.col("ref_start"))).alias("pos"))
        .groupBy("ref_idx", "pos")
        .agg(F.count(F.lit(1)).alias("n"))
    )
