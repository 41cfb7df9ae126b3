"""Alignment of two tokenizers' tokens by the bytes they cover.

A batch of texts is encoded on both sides. Within a document each token start finds the
token of the other side that covers it (``pandas.merge_asof``, both ways); the union of
the two directions is every pair of tokens whose bytes overlap, and places where tokens
of both sides end cut a text into groups.

Counts of id pairs are over all documents. Documents are gathered in chunks of bounded
size, which name each of their pairs once: only these names are shuffled to be summed,
and each chunk gets its sums back. No table of all pairs is sent to any task.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basewise.llm.common import field, numbered, per_process, slices, text_of
from basewise.session import materialize, scratch, scratch_path

#: Links of a chunk, from which on it is closed.
CHUNK = 1 << 20
#: Units of text that a Python worker remembers in each of two generations, and the longest one remembered.
REMEMBERED, LONGEST = 200_000, 64
_ID_BITS = 24


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Side:
    """One tokenizer: ids of texts, and what each id is in bytes.

    Texts are cut into units that no token crosses, which are encoded once and remembered
    in two generations: byte-level tokenizers cut by a pattern before they merge, and no
    SentencePiece token here has a space symbol after another character.
    """

    def __init__(self, path: str) -> None:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            entries = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            if any(re.search("[^▁]▁", e) for i, e in enumerate(entries) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))):
                raise ValueError("only models whose tokens end where a word ends")
            self.units = re.compile(" *[^ ]+| +").findall
            # The model puts a space before what it gets, unless that is empty; so that of the unit is left out.
            space = [model.piece_to_id("▁")]
            self.encode = lambda units: [ids if u != " " else space for u, ids in zip(units, model.encode([u[1:] for u in units], num_threads=1))]
            self.entries = [bytes([int(e[1:-1], 16)]) if model.is_byte(i) else e.replace("▁", " ").encode() for i, e in enumerate(entries)]
        else:
            import public_tokenizers
            import regex
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            letters = byte_letters()
            self.units = regex.compile(public_tokenizers.PATTERN).findall
            self.encode = lambda units: [e.ids for e in tokenizer.encode_batch_fast(units, add_special_tokens=False)]
            entries = [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())]
            self.entries = [bytes(letters[c] for c in e) if all(c in letters for c in e) else e.encode() for e in entries]
        self.lengths = np.array([len(e) for e in self.entries], dtype=np.int64)
        # Ids as text, followed by a comma or by the end of a group.
        self.names = np.array([*(f"{i}," for i in range(len(entries))), *(f"{i}\n" for i in range(len(entries)))], dtype=object)
        # Units met of late and before, their ids as 32-bit numbers; and units whose ids do not hold their bytes.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.changed: set[str] = set()

    def tokens(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with a space before it, as 32-bit numbers; none where their bytes are not those of the text."""
        split = [self.units(" " + t) for t in texts]
        young, old, entries = self.young, self.old, self.entries
        fresh = []
        for unit in set().union(*split).difference(young):
            if unit in old:
                young[unit] = old[unit]
            else:
                fresh.append(unit)
        for at in range(0, len(fresh), 4096):
            some = fresh[at : at + 4096]
            ids = self.encode(some)
            flat = list(chain.from_iterable(ids))
            ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
            packed, edges = np.array(flat, "<i4").tobytes(), [0, *(4 * ends).tolist()]
            young.update(zip(some, map(packed.__getitem__, map(slice, edges, edges[1:]))))
            # Units hold their bytes if all together do, and each ends where its tokens end.
            bounds = np.concatenate([[0], np.cumsum(self.lengths[flat])])[ends]
            sizes = np.fromiter((len(u.encode()) for u in some), np.int64, len(some))
            if b"".join([entries[i] for i in flat]) != "".join(some).encode() or not np.array_equal(bounds, np.cumsum(sizes)):
                self.changed.update(u for u, own in zip(some, ids) if b"".join([entries[i] for i in own]) != u.encode())
        changed, known = self.changed, young.__getitem__
        out = [b"".join(map(known, units)) if changed.isdisjoint(units) else b"" for units in split]
        for unit in fresh:
            if len(unit) > LONGEST:
                del young[unit]
                changed.discard(unit)
        if len(young) > REMEMBERED:
            self.young, self.old = {}, young
            changed.intersection_update(young)
        return out


def _frame(ids: list[bytes], lengths: np.ndarray) -> pd.DataFrame:
    """``doc, at, end, id`` of all tokens of a batch; places count on from document to document."""
    flat = np.frombuffer(b"".join(ids), dtype="<i4").astype(np.int64)
    end = np.cumsum(lengths[flat])
    return pd.DataFrame({"doc": np.repeat(np.arange(len(ids)), [len(own) // 4 for own in ids]), "at": end - lengths[flat], "end": end, "id": flat})


def _covering(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """For each token of ``left`` the place of the token of ``right`` that covers its start.

    Both sides hold the same bytes of each document, so places alone tell the document.
    """
    named = right[["at"]].assign(place=np.arange(len(right)))
    return pd.merge_asof(left[["at"]], named, on="at")["place"].to_numpy(np.int64)


def _groups(frame: pd.DataFrame, cut: np.ndarray, names: np.ndarray, sizes: np.ndarray) -> list[list[str]]:
    """Each document's groups of ids, joined by commas; ``sizes`` are their numbers. The last token of a text ends a group."""
    words = names.take(frame["id"].to_numpy() + cut * (len(names) // 2))
    groups, edges = "".join(words.tolist()).split("\n"), np.concatenate([[0], np.cumsum(sizes)]).tolist()
    return [groups[a:b] for a, b in zip(edges, edges[1:])]


def align(texts: list[str], a: Side, b: Side) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Documents ``n_a, n_b, n_groups, n_links, groups`` and links ``doc, a, b`` (places in the batch's tokens are gone).

    A text that is empty, or whose bytes one side changes, has no tokens on either.
    """
    ids_a, ids_b = a.tokens(texts), b.tokens(texts)
    whole = [bool(t and x and y) for t, x, y in zip(texts, ids_a, ids_b)]
    ids_a = [x if ok else b"" for x, ok in zip(ids_a, whole)]
    ids_b = [y if ok else b"" for y, ok in zip(ids_b, whole)]
    one, two = _frame(ids_a, a.lengths), _frame(ids_b, b.lengths)
    docs = len(texts)
    under = _covering(one, two)  # of B, by A's starts
    over = _covering(two, one)  # of A, by B's starts
    # A pair whose starts are equal is found in both directions.
    new = one["at"].to_numpy()[over] != two["at"].to_numpy()
    left = np.concatenate([np.arange(len(one)), over[new]])
    right = np.concatenate([under, np.flatnonzero(new)])
    links = pd.DataFrame({"doc": one["doc"].to_numpy()[left], "a": one["id"].to_numpy()[left], "b": two["id"].to_numpy()[right]})
    both = np.intersect1d(one["end"].to_numpy(), two["end"].to_numpy(), assume_unique=True)
    cut_a, cut_b = np.isin(one["end"].to_numpy(), both), np.isin(two["end"].to_numpy(), both)
    count = lambda own, weights=None: np.bincount(own, weights, minlength=docs).astype(np.int64)
    n_groups = count(one["doc"].to_numpy(), cut_a)
    groups = [";".join(map("|".join, zip(x, y))) for x, y in zip(_groups(one, cut_a, a.names, n_groups), _groups(two, cut_b, b.names, n_groups))]
    facts = pd.DataFrame({
        "n_a": [len(x) // 4 for x in ids_a], "n_b": [len(y) // 4 for y in ids_b], "n_groups": n_groups,
        "n_links": count(links["doc"].to_numpy()), "groups": groups,
    })
    return facts, links


def _packed(codes: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Each document's codes, in rising order, as differences, first bytes first: mostly zeros, which compress well."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    codes = np.sort((doc << 32) | codes) & 0xFFFFFFFF
    edges = np.concatenate([[0], np.cumsum(sizes)])
    steps = np.diff(codes, prepend=0)
    steps[edges[:-1][sizes > 0]] = codes[edges[:-1][sizes > 0]]
    cells = steps.astype("<u4").view(np.uint8).reshape(-1, 4)
    return [cells[a:b].T.tobytes() for a, b in zip(edges, edges[1:])]


def _unpacked(packed: list[bytes]) -> np.ndarray:
    """The codes of all documents in a row."""
    out = [np.ascontiguousarray(np.frombuffer(p, np.uint8).reshape(4, -1).T).view("<u4").ravel().cumsum(dtype=np.int64) for p in packed]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def _chunks(rows: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row a document with its links as numbers of pairs (``codes``), and one a chunk with its pairs and how often each is linked."""
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), rows.schema["id"], *[T.StructField(n, T.LongType()) for n in _COUNTS], T.StructField("groups", T.StringType()),
        T.StructField("codes", T.BinaryType()), T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType())),
    ])

    def closed(number: int, docs: list, sizes: list, pairs: list) -> pa.RecordBatch:
        key = np.concatenate(pairs)
        names, codes, times = np.unique(key, return_inverse=True, return_counts=True)
        # Frequent pairs get small numbers.
        order = np.argsort(-times, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        names, times, codes = names[order], times[order], place[codes]
        facts = pd.concat([f for _, f in docs], ignore_index=True)
        n = len(facts)
        packed = _packed(codes, np.concatenate(sizes))
        ids = pa.concat_arrays([i for i, _ in docs] + [pa.nulls(1, docs[0][0].type)])
        blank = lambda column, kind: pa.array([*column, None], kind)
        columns = [
            pa.array(np.full(n + 1, number)), ids, *[blank(facts[c].tolist(), pa.int64()) for c in _COUNTS], blank(facts["groups"], pa.string()), blank(packed, pa.binary()),
            pa.array([None] * n + [names], pa.list_(pa.int64())), pa.array([None] * n + [times], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = per_process(f"side {path_a}", lambda: Side(path_a)), per_process(f"side {path_b}", lambda: Side(path_b))
        docs, sizes, pairs, held, first = [], [], [], 0, None
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            first = batch.column("row")[0].as_py() if first is None else first
            facts, links = align(batch.column("text").to_pylist(), a, b)
            order = np.argsort(links["doc"].to_numpy(), kind="stable")
            pairs.append((links["a"].to_numpy()[order] << _ID_BITS) | links["b"].to_numpy()[order])
            sizes.append(facts["n_links"].to_numpy())
            facts["groups"] = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in facts["groups"]]
            docs.append((batch.column("id"), facts))
            held += len(links)
            if held >= CHUNK:
                yield closed(first, docs, sizes, pairs)
                docs, sizes, pairs, held, first = [], [], [], 0, None
        if docs:
            yield closed(first, docs, sizes, pairs)

    return rows.mapInArrow(run, schema)


def align_table(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each row.

    Side A is a byte-level tokenizer file, which gets a space before the text; side B a
    SentencePiece model, which adds one. A pair of ids counts how many links of all
    documents hold it; ``n_best`` counts a document's links whose pair is its B id's most
    frequent (ties included), ``count_sum`` sums the counts over its links. Texts that are
    null, empty or changed by a side have zeros and ''. Repeated rows count as often as
    they occur; an empty table gives no rows; other columns are never read.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "aligned")
    with scratch(spark):
        rows = numbered(df, id=F.col(f"`{id_col}`"), text=text_of(text_col))
        stored = materialize(_chunks(rows, path_a, path_b), "aligned-chunks")
        each = stored.filter("pairs is not null").select("chunk", F.posexplode(F.arrays_zip("pairs", "times")).alias("code", "own"))
        each = each.select("chunk", "code", F.col("own.pairs").alias("pair"), F.col("own.times").alias("times"))
        totals = materialize(each.groupBy("pair").agg(F.sum("times").alias("total")), "pair-totals")
        side = F.col("pair").bitwiseAND(F.lit((1 << _ID_BITS) - 1).cast("long"))
        top = totals.groupBy(side.alias("b")).agg(F.max("total").alias("top"))  # one row for each id of side B
        totals = totals.join(F.broadcast(top), side == F.col("b")).select("pair", "total", (F.col("total") == F.col("top")).alias("best"))
        sums = each.join(totals, "pair").select(F.col("chunk").alias("home"), "code", "total", "best")
        docs = stored.filter("pairs is null").select("chunk", "id", *_COUNTS, "groups", "codes")
        schema = T.StructType([
            field(df, id_col, "id"), *[T.StructField(n, T.LongType()) for n in (*_COUNTS, "n_best", "count_sum")], T.StructField("groups_sha256", T.StringType()),
        ])

        def summed(docs: pa.Table, sums: pa.Table) -> pa.Table:
            total, best = np.zeros(sums.num_rows, np.int64), np.zeros(sums.num_rows, np.int64)
            at = sums.column("code").to_numpy()
            total[at] = sums.column("total").to_numpy()
            best[at] = sums.column("best").to_numpy().astype(np.int64)
            sizes = docs.column("n_links").to_numpy()
            edges = np.concatenate([[0], np.cumsum(sizes)])
            flat = _unpacked(docs.column("codes").to_pylist())
            over = lambda values: np.diff(np.concatenate([[0], np.cumsum(values[flat])])[edges])
            columns = [docs.column(c) for c in ("id", *_COUNTS)] + [pa.array(over(best)), pa.array(over(total)), docs.column("groups")]
            return pa.Table.from_arrays(columns, names=schema.fieldNames())

        out = docs.groupBy("chunk").cogroup(sums.groupBy("home")).applyInArrow(summed, schema)
        out.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
