"""Ranked lexical search by sequential impact-sorted reads (NRA, no random access).

Documents are cut into shards of bounded size. In a shard the postings of each term are
sorted by impact, highest first. For a query the lists of its terms are read block by
block; every document has a lower score (what has been read of it) and an upper one
(plus the next unread contribution of each list that has not shown it). Once no document
outside can reach the k-th lower score, only documents that still can are followed, and
reading goes on until membership, ties and scores are exact: each of them has been
seen in a list or the list is at its end. The best of the shards' best are the result.

Scores are 64-bit integers. Statistics (documents, terms, document frequencies) are
over all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basewise.llm.common import field, map_batches, numbered, text_of
from basewise.session import materialize, scratch, scratch_path

#: Documents and postings of a shard, first block read of a list, and queries worked on in one pass.
DOCUMENTS, POSTINGS, READ, QUERIES = 1 << 13, 1 << 21, 64, 2048
# Bytes that are no part of a term become spaces; A-Z become a-z. All bytes above 0x7F are part of terms.
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms(text: str) -> list[bytes]:
    """Runs of ASCII letters, digits and other code points above U+007F, with A-Z lower-cased."""
    return text.encode().translate(_LETTERS).split()


@dataclass
class Query:
    """One item: its number, and the codes and weights of its terms."""

    item: int
    codes: np.ndarray
    weights: np.ndarray


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _counted(docs: DataFrame, codes: dict[bytes, int]) -> DataFrame:
    """``id, n, codes, tf`` of each document: all its terms, and which of the queries' terms it holds how often."""
    schema = T.StructType([
        docs.schema["id"], T.StructField("n", T.LongType()),
        T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.IntegerType())),
    ])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, held, often = [], [], []
        for text in batch.column("text"):
            found = terms(text.as_py())
            n.append(len(found))
            own = Counter(found)
            held.append([codes[t] for t in own if t in codes])
            often.append([c for t, c in own.items() if t in codes])
        lists = [pa.array(n, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([batch.column("id"), *lists], names=schema.fieldNames())

    return map_batches(docs, run, schema)


class Shard:
    """Impact-sorted postings of some documents, which are numbered in order of their ids (null last)."""

    def __init__(self, table: pa.Table, documents: int, length: int) -> None:
        table = table.take(pc.sort_indices(table, [("id", "ascending")], null_placement="at_end")).combine_chunks()
        self.ids, self.documents = table.column("id").combine_chunks(), table.num_rows
        lists = table.column("codes").combine_chunks()
        doc = np.repeat(np.arange(self.documents), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        code, tf = lists.flatten().to_numpy(), table.column("tf").combine_chunks().flatten().to_numpy().astype(np.int64)
        m = 100 - 50 + 50 * table.column("n").to_numpy() * documents // max(1, length)
        impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[doc])
        order = np.lexsort((-impact, code))
        self.code, self.doc, self.impact = code[order], doc[order], impact[order]

    def best(self, query: Query, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and exact scores of the ``k`` best above 0, ties in order of documents."""
        start, end = np.searchsorted(self.code, query.codes), np.searchsorted(self.code, query.codes, side="right")
        some = (end > start) & (query.weights > 0)
        start, end, weights = start[some], end[some], query.weights[some]
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lower, seen = np.zeros(self.documents, np.int64), np.zeros((len(start), self.documents), bool)
        at, block, floor = start.copy(), READ, 0
        # First part: until no unseen document can be among the best, or tie with them.
        while True:
            for t in range(len(at)):
                stop = min(at[t] + block, end[t])
                docs = self.doc[at[t]:stop]
                lower[docs] += weights[t] * self.impact[at[t]:stop]
                seen[t, docs] = True
                at[t] = stop
            heads = self._heads(at, end, weights)
            met = lower > 0
            if met.sum() >= k:
                floor = np.partition(lower, -k)[-k]
            if heads.sum() < floor or not heads.any():
                break
            block *= 2
        # Second part: those that still can are read to the end of the doubt.
        left = np.flatnonzero(lower > 0)
        while True:
            heads = self._heads(at, end, weights)
            doubt = ~seen[:, left] & (heads > 0)[:, None]
            upper = lower[left] + (doubt * heads[:, None]).sum(axis=0)
            floor = max(floor, np.partition(lower[left], -k)[-k] if len(left) >= k else 0)
            keep = upper >= floor
            left, doubt = left[keep], doubt[:, keep]
            if not doubt.any():
                break
            wanted = np.zeros(self.documents, bool)
            wanted[left] = True
            block *= 2
            for t in np.flatnonzero(doubt.any(axis=1)):
                stop = min(at[t] + block, end[t])
                docs, impact = self.doc[at[t]:stop], self.impact[at[t]:stop]
                inside = wanted[docs]
                lower[docs[inside]] += weights[t] * impact[inside]
                seen[t, docs[inside]] = True
                at[t] = stop
        order = left[np.argsort(-lower[left], kind="stable")][:k]
        return order, lower[order]

    def _heads(self, at: np.ndarray, end: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The most that the unread rest of each list can add to a document."""
        return np.where(at < end, weights * self.impact[np.minimum(at, len(self.impact) - 1)], 0)


def _ranked(stored: DataFrame, queries: list[Query], documents: int, length: int, k: int) -> DataFrame:
    """``item, id, score``: of each shard the ``k`` best for each query."""
    schema = T.StructType([T.StructField("item", T.LongType()), stored.schema["id"], T.StructField("score", T.LongType())])

    def searched(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(pa.Table.from_batches(parts), documents, length)
        for query in queries:
            docs, scores = shard.best(query, k)
            if len(docs):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), query.item)), shard.ids.take(pa.array(docs)), pa.array(scores)], names=schema.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, postings = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                held.append(part)
                rows += part.num_rows
                postings += len(part.column("codes").flatten())
                if rows >= DOCUMENTS or postings >= POSTINGS:
                    yield from searched(held)
                    held, rows, postings = [], 0, 0
        if held:
            yield from searched(held)

    return stored.mapInArrow(run, schema)


def search(
    df: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """``item_id, rank, id, score``: the ``k`` documents that score highest above 0 for each row of ``items``.

    Equal scores are ranked by id (nulls last). Null texts have no terms: such documents
    are found by no item, such items find none. Repeated documents and repeated items are
    rows of their own. Empty tables give no rows; other columns are never read. Items are
    searched in blocks of about ``QUERIES``, each in one pass over the documents.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "ranked")
    schema = T.StructType([field(items, item_col, "item_id"), T.StructField("rank", T.IntegerType()), field(df, id_col, "id"), T.StructField("score", T.LongType())])
    spark.createDataFrame([], schema).write.parquet(path)
    with scratch(spark):
        asked = materialize(numbered(items, id=F.col(f"`{item_col}`"), text=text_of(item_text_col)), "items")
        docs = numbered(df, id=F.col(f"`{id_col}`"), text=text_of(text_col)).select("id", "text")
        blocks = max(1, -(-asked.count() // QUERIES))
        for block in range(blocks):
            own = asked.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block)
            found = {r["row"]: sorted(set(terms(r["text"]))) for r in own.select("row", "text").toLocalIterator()}
            codes = {t: i for i, t in enumerate(sorted(set().union(*found.values())))}
            if not codes:
                continue
            stored = materialize(_counted(docs, codes), "counted")
            facts = stored.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
            holding = np.zeros(len(codes), np.int64)
            for r in stored.select(F.explode("codes").alias("code")).groupBy("code").count().toLocalIterator():
                holding[r["code"]] = r["count"]
            weights = np.array([weight(facts["documents"], int(h)) for h in holding], np.int64)
            queries = []
            for item, words in found.items():
                mine = np.array([codes[t] for t in words], np.int64)
                queries.append(Query(item, mine, weights[mine]))
            ranked = _ranked(stored, queries, facts["documents"], facts["length"], k)
            first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
            top = ranked.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
            names = own.select(F.col("row").alias("item"), F.col("id").alias("item_id"))
            top.join(F.broadcast(names), "item").select("item_id", "rank", "id", "score").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
