"""Packing of documents into sequences by linear grouping and best fit.

The plan is made from the histogram of piece lengths, which has at most ``size`` rows
however many documents there are: large lengths are sorted and rounded up within
groups of equal cardinality, a linear programme over fillings of a sequence with the
few rounded sizes is optimised by column generation, and true lengths are put in for
the rounded ones. The last place of a filling takes what fits it best of all that is
left, so that what rounding up wastes is used: it is filled with all other pieces by best
fit, longest first. Pieces of one
length are interchangeable, so a piece finds its place from its rank within its length.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from dataclasses import dataclass, field as slot

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basewise.llm.common import field, map_batches, numbered, text_of
from basewise.session import materialize

SIZE = 2048
#: (share of a sequence over which a piece is large, number of groups) that are tried; the fewest sequences win.
TRIED = ((1 / 8, 64), (1 / 8, 40), (1 / 4, 64))
#: Units of text whose ids a Python worker remembers in each of two generations.
REMEMBERED = 200_000

# White space ends a unit. So does the end of a run of letters before a comma, a full stop or white space, where
# the tokenizer cuts too; anything else stays in one unit.
_UNIT = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]++(?![^ \t\n\r\x0b\x0c,.])|[^ \t\n\r\x0b\x0c]++")
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


class Words:
    """Ids of units of text, remembered; units not met for a generation are forgotten."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        # The tokenizer finds its markers (<|endoftext|>) before it lower-cases, so a text that may hold one goes to it as it is.
        # Elsewhere lower-casing is its first step; on ASCII any way of doing it is the same.
        split = [_UNIT.findall(t.lower() if t.isascii() and "<|" not in t else t) for t in texts]
        young, old = self.young, self.old
        missing = set().union(*split).difference(young)
        fresh = []
        for unit in missing:
            if unit in old:
                young[unit] = old[unit]
            elif _LETTERS.fullmatch(unit):
                # Letters below U+0100 are one word to the tokenizer, whose model is asked directly.
                own = self.model.tokenize(unit.lower().translate(self.letters))
                young[unit] = struct.pack(f"<{len(own)}I", *[t.id for t in own])
            else:
                fresh.append(unit)
        for at in range(0, len(fresh), 4096):
            part = fresh[at:at + 4096]
            for unit, got in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                own = got.ids
                young[unit] = struct.pack(f"<{len(own)}I", *own)
        out = [b"".join(map(young.__getitem__, units)) for units in split]
        if len(young) > REMEMBERED:
            self.young, self.old = {}, young
        return out


_WORDS: dict[str, Words] = {}


def word_ids(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and never joins across it, nor across the edge of
    a run of letters, so units between such places are encoded alone, and each once.
    """
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path].ids(texts)


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = 0) -> DataFrame:
    """``row, id, piece, start, length, ids_crc32``: each document's ids and ``end_id``, cut where longer than ``size``.

    A null or empty text has ``end_id`` alone.
    """
    schema = T.StructType([
        T.StructField("row", T.LongType()), field(df, id_col, "id"), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        source, piece, start, length, crc = [], [], [], [], []
        for i, ids in enumerate(word_ids(batch.column("text").to_pylist(), tokenizer)):
            ids += end
            for k, at in enumerate(range(0, len(ids), 4 * size)):
                part = ids[at:at + 4 * size]
                source.append(i)
                piece.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        take = pa.array(source, pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("row").take(take), batch.column("id").take(take), pa.array(piece, pa.int32()),
             pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            names=["row", "id", "piece", "start", "length", "ids_crc32"],
        )

    return map_batches(numbered(df, id=F.col(f"`{id_col}`"), text=text_of(text_col)), cut, schema)


@dataclass
class Plan:
    """Runs of places: pieces ``first`` to ``first + count`` of ``length`` lie at ``offset`` of successive sequences."""

    size: int
    sequences: int = 0
    #: Pieces that fillings placed in sequences of several.
    company: int = 0
    runs: list[tuple[int, int, int, int, int]] = slot(default_factory=list)
    given: dict[int, int] = slot(default_factory=lambda: defaultdict(int))
    #: Sequences by the room left: runs (first sequence, count).
    room: dict[int, list[tuple[int, int]]] = slot(default_factory=lambda: defaultdict(list))
    rooms: list[int] = slot(default_factory=list)

    def open(self, count: int) -> int:
        first, self.sequences = self.sequences, self.sequences + count
        return first

    def put(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.given[length], count, sequence, offset))
        self.given[length] += count

    def leave(self, room: int, sequence: int, count: int) -> None:
        if room and count:
            if not self.room[room]:
                insort(self.rooms, room)
            self.room[room].append((sequence, count))

    def best_fit(self, length: int, count: int) -> None:
        """``count`` pieces, each into the fullest sequence with room for it."""
        while count:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                room, each = self.size, min(self.size // length, count)
                many = count // each
                first, free = self.open(many), 0
            else:
                room = self.rooms[at]
                first, free = self.room[room].pop()
                if not self.room[room]:
                    self.rooms.pop(at)
                each = min(room // length, count)
                many = min(count // each, free)
            for i in range(each):
                self.put(length, many, first, self.size - room + i * length)
            self.leave(room - each * length, first, many)
            self.leave(room, first + many, max(0, free - many))
            count -= each * many


def _fillings(sizes: np.ndarray, demand: np.ndarray, size: int) -> list[tuple[np.ndarray, float]]:
    """Fillings of a sequence and how often each is used, by column generation; optimal but for rounding."""
    k = len(sizes)
    basis = np.diag((size // sizes).astype(float))
    for _ in range(40 * k):
        inverse = np.linalg.inv(basis)
        price = np.ones(k) @ inverse
        column = _knapsack(sizes, price, size)
        if price @ column <= 1 + 1e-7:
            break
        amounts, change = inverse @ demand, inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(change > 1e-9, np.maximum(amounts, 0) / change, np.inf)
        if not np.isfinite(ratio.min()):
            break
        basis[:, int(ratio.argmin())] = column
    amounts = np.linalg.inv(basis) @ demand
    return [(basis[:, i].astype(int), float(amounts[i])) for i in range(k)]


def _knapsack(sizes: np.ndarray, price: np.ndarray, size: int) -> np.ndarray:
    """The filling of highest price."""
    best = np.zeros(size + 1)
    copies = np.zeros((len(sizes), size + 1), dtype=np.int16)
    for g, (s, p) in enumerate(zip(sizes.tolist(), price.tolist())):
        if p <= 0:
            continue
        for _ in range(size // s):
            more = best[:-s] + p > best[s:] + 1e-12
            if not more.any():
                break
            grown = np.where(more, copies[g, :-s] + 1, copies[g, s:])
            best[s:] = np.where(more, best[:-s] + p, best[s:])
            copies[g, s:] = grown
    column, room = np.zeros(len(sizes)), size
    for g in range(len(sizes) - 1, -1, -1):
        column[g] = copies[g, room]
        room -= int(copies[g, room]) * int(sizes[g])
    return column


def _grouped(counts: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Large lengths, longest first, in groups of equal cardinality: lists of [length, count]."""
    total, out, filled = sum(counts.values()), [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            g = filled * groups // total
            take = min(left, -(-(g + 1) * total // groups) - filled)
            while len(out) <= g:
                out.append([])
            out[g].append([length, take])
            filled, left = filled + take, left - take
    return [g for g in out if g]


def make_plan(counts: dict[int, int], size: int = SIZE, tried: tuple[tuple[float, int], ...] = TRIED) -> Plan:
    """The best plan for so many pieces of each length (1 to ``size``)."""
    return min((_plan(counts, size, share, groups) for share, groups in tried), key=lambda p: p.sequences)


def _plan(counts: dict[int, int], size: int, share: float, groups: int) -> Plan:
    plan, rest = Plan(size), dict(counts)
    if full := rest.pop(size, 0):
        plan.put(size, full, plan.open(full), 0)
    large = {n: c for n, c in rest.items() if n > size * share}
    if large:
        grouped = _grouped(large, min(groups, sum(large.values())))
        # Groups of one rounded length are one size.
        merged: dict[int, list[list[int]]] = {}
        for g in grouped:
            merged.setdefault(g[0][0], []).extend(g)
        sizes = np.array(list(merged), dtype=np.int64)
        stock = list(merged.values())
        demand = np.array([sum(c for _, c in g) for g in stock], dtype=float)
        for filling, amount in _fillings(sizes, demand, size):
            many = int(amount + 1e-7)
            many = min([many, *(sum(c for _, c in stock[g]) // n for g, n in enumerate(filling.tolist()) if n)])
            if many <= 0 or filling.sum() < 2:
                continue
            parts = [(plan.open(many), many, size)]
            # Sizes fall, so the smallest place stays open.
            for g in np.repeat(np.arange(len(sizes)), filling)[:-1].tolist():
                parts = _substitute(plan, parts, stock[g], rest)
                plan.company += many
            for first, count, room in parts:
                plan.leave(room, first, count)
    for length in sorted(rest, reverse=True):
        plan.best_fit(length, rest[length])
    return plan


def _substitute(plan: Plan, parts: list[tuple[int, int, int]], stock: list[list[int]], rest: dict[int, int]) -> list[tuple[int, int, int]]:
    """One true piece of the group into each sequence of ``parts`` (first, count, room), longest first."""
    out = []
    for first, count, room in parts:
        while count:
            length, have = stock[0]
            take = min(count, have)
            plan.put(length, take, first, plan.size - room)
            rest[length] -= take
            out.append((first, take, room - length))
            first, count = first + take, count - take
            if take == have:
                stock.pop(0)
            else:
                stock[0][1] -= take
    return out


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """``row, id, piece, start, length, ids_crc32, sequence_id, offset`` of each piece.

    Every document is packed; only those longer than ``size`` are cut. Null and empty
    texts hold the end id alone. Repeated rows are packed each; an empty table gives
    no rows; other columns are never read.
    """
    stored = materialize(pieces(df, tokenizer, id_col, text_col, size), "pieces")
    # A length may be that of a third of all pieces: ranks are taken within salted parts.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = stored.withColumn("salt", F.pmod(F.xxhash64("row", "piece"), F.lit(parts)))
    counts = materialize(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    plan = make_plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)
    base = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row", "piece"))
    ranked = salted.withColumn("within", within - 1).join(base, ["length", "salt"]).withColumn("rank", F.col("within") + F.col("base"))
    runs = np.array(sorted(plan.runs), dtype=np.int64).reshape(-1, 5)
    keys = (runs[:, 0] << 44) + runs[:, 1]
    names = ["row", "id", "piece", "start", "length", "ids_crc32"]
    schema = T.StructType([*(stored.schema[n] for n in names), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        rank = batch.column("rank").to_numpy(zero_copy_only=False)
        run = runs[np.searchsorted(keys, (batch.column("length").to_numpy(zero_copy_only=False) << 44) + rank, side="right") - 1]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array(run[:, 3] + rank - run[:, 1], pa.int64()), pa.array(run[:, 4], pa.int64())],
            names=[*names, "sequence_id", "offset"],
        )

    return map_batches(ranked.select(*names, "rank"), place, schema)
