"""Exact deduplication by content-defined chunk recipes.

A text is cut where a rolling hash of its last 32 bytes has zero low bits, so equal
passages give equal chunks. Chunks are deduplicated by content, which proves that one
identifier stands for one content. Texts are then compared by their ordered lists of
identifiers; the long texts themselves do not move again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basewise.llm.common import field, map_batches, numbered, text_of
from basewise.session import materialize

#: Bytes of a chunk: the mean distance of cuts beyond LEAST, and the bounds.
MEAN, LEAST, MOST = 2048, 512, 16384
WINDOW_STEPS = (1, 2, 4, 8, 16)
_GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**32, 256, dtype=np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the 32 bytes that end there (fewer at the start)."""
    h = _GEAR[data]
    for step in WINDOW_STEPS:
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def cuts(hashes: np.ndarray, start: int, end: int, marks: np.ndarray) -> list[int]:
    """Ends of the chunks of bytes ``start`` to ``end``; ``marks`` are sorted places after which a cut may lie.

    No chunk but the last is shorter than LEAST, so that no window reaches back over
    the start of a text: the cuts depend on the text alone.
    """
    found, at = [], start
    own = marks[np.searchsorted(marks, start + LEAST - 1):np.searchsorted(marks, end - 1)].tolist() if end - start > LEAST else []
    for mark in own:
        while mark + 1 - at > MOST:
            at += MOST
            found.append(at)
        if mark + 1 - at >= LEAST:
            at = mark + 1
            found.append(at)
    while end - at > MOST:
        at += MOST
        found.append(at)
    if end > at:
        found.append(end)
    return found


def chunks(texts: pa.Array) -> list[list[bytes]]:
    """The chunks of each text of a string array."""
    parts = [(t or "").encode() for t in texts.to_pylist()]
    data = b"".join(parts)
    hashes = rolling(np.frombuffer(data, dtype=np.uint8))
    marks = np.flatnonzero((hashes & np.uint32(MEAN - 1)) == 0)
    out, at = [], 0
    for part in parts:
        ends = cuts(hashes, at, at + len(part), marks)
        out.append([data[a:b] for a, b in zip([at, *ends], ends)])
        at += len(part)
    return out


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def identifiers(chunk: bytes, words: int, bits: int) -> list[int]:
    """``words`` hash values of ``bits`` bits."""
    return [_signed(xxhash.xxh64_intdigest(chunk, seed) & ((1 << bits) - 1)) for seed in range(words)]


def normalised(column: str) -> F.Column:
    """Each run of ASCII white space as one space, null as empty."""
    return F.regexp_replace(text_of(column), "[\\x20\\x09-\\x0D]+", " ")


def _distinct(rows: DataFrame, words: int, bits: int) -> bool:
    """Whether no two different chunks share an identifier."""
    schema = T.StructType([T.StructField("id", T.ArrayType(T.LongType())), T.StructField("chunk", T.BinaryType())])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        every = list({c for own in chunks(batch.column("text")) for c in own})
        return pa.RecordBatch.from_arrays(
            [pa.array([identifiers(c, words, bits) for c in every], pa.list_(pa.int64())), pa.array(every, pa.binary())], names=["id", "chunk"]
        )

    contents = map_batches(rows.select("text"), cut, schema).distinct()
    return contents.groupBy("id").count().filter("count > 1").isEmpty()


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, bits: int = 64) -> DataFrame:
    """For each row ``row, id, keep_id, keep_row, group_size, kept, text_sha256``.

    Texts are equal when identical after each run of ASCII white space became one
    space; null counts as empty. The row with the smallest id stays (null ids last;
    of rows with one id, the first read). Repeated rows are rows of their own, of which
    one stays. An empty table gives no rows; other columns are never read.

    Identifiers start as one 64-bit word. Should two different chunks share one, words
    are added until none do, so that equal lists always mean equal texts.
    """
    rows = numbered(df, row_col, id=F.col(f"`{id_col}`"), text=normalised(text_col))
    words = 1
    while not _distinct(rows, words, bits):
        words += 1
    schema = T.StructType([
        T.StructField("row", T.LongType()), field(df, id_col, "id"),
        T.StructField("recipe", T.ArrayType(T.LongType())), T.StructField("text_sha256", T.StringType()),
    ])

    def recipe(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = chunks(batch.column("text"))
        lists = [[w for c in one for w in identifiers(c, words, bits)] for one in own]
        digests = [hashlib.sha256(b"".join(one)).hexdigest() for one in own]
        return pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("id"), pa.array(lists, pa.list_(pa.int64())), pa.array(digests, pa.string())],
            names=["row", "id", "recipe", "text_sha256"],
        )

    recipes = materialize(map_batches(rows, recipe, schema), "recipes")
    # Stored before the join, so that both sides are dealt anew and a hot list can be split.
    groups = materialize(
        recipes.groupBy("recipe").agg(
            F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"), F.count("*").alias("group_size")
        ).select("recipe", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size"),
        "recipe-groups",
    )
    return recipes.join(groups, "recipe").select(
        "row", "id", "keep_id", "keep_row", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )
