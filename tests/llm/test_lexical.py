"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import pytest

from basewise.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    """Every document scored for every item."""
    held = [Counter(words(t)) for _, t in docs]
    n_docs, length = sum(1 for h in held if h), sum(sum(h.values()) for h in held)
    df = Counter(t for h in held for t in h)
    out = []
    for item, text in items:
        scores = []
        for (doc, _), own in zip(docs, held):
            m = 100 - 50 + (50 * sum(own.values()) * n_docs) // max(1, length)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * own[t] // (1000 * own[t] + 20 * m)) for t in set(words(text)) if t in own)
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, i + 1, None if none else doc, -score) for i, (score, none, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def got(spark, docs, items, k):
    left = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, codes string").repartition(3)
    right = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, id int")
    return sorted(map(tuple, lexical.search(left, right, k).collect()), key=str)


@pytest.mark.parametrize("shard, read, block", [(8192, 64, 2048), (40, 2, 3)])
def test_search_as_scoring_all(spark, monkeypatch, shard, read, block):
    for name, value in (("DOCUMENTS", shard), ("READ", read), ("QUERIES", block)):
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(4)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 300}"
    docs = [(i, " ".join(word() for _ in range(rng.choice([1, 5, 30, 200])))) for i in range(300)]
    docs += [(1000 + i, "w1 w2 w250 the same") for i in range(120)]  # one text in a third of the rows, all tied
    docs += [(2000, None), (2001, ""), (2002, "-- \t .,"), (2003, "ÀÉ W1ß中文 w1\x80 İ"), (2004, "w7 " * 30_000), (5, "w1 w7"), (None, "w250 w1"), (None, "w2")]
    items = [(1, "W1 w7, w250; w1"), (2, None), (3, "..."), (4, "the SAME w299"), (5, "àé ÀÉ w1ß中文"), (6, "nowhere"), (7, " ".join(f"w{i}" for i in range(300))), (None, "w3 w4")]
    assert got(spark, docs, items, 50) == brute(docs, items, 50)
    assert got(spark, docs, items[:5], 1) == brute(docs, items[:5], 1)


def test_reads_stop_early():
    import numpy as np
    import pyarrow as pa

    table = pa.table({"id": np.arange(4000), "n": np.arange(4000) + 10, "codes": pa.array([[0, 1]] * 4000, pa.list_(pa.int32())), "tf": pa.array([[1, 1]] * 4000, pa.list_(pa.int32()))})
    shard = lexical.Shard(table, 4000, 200_000)
    docs, scores = shard.best(lexical.Query(0, np.array([0, 1]), np.array([5, 3])), 3)
    assert docs.tolist() == [0, 1, 2] and scores[0] > scores[1] > scores[2]
    shard.doc[1000:4000] = -10**9  # a read beyond the first blocks would fail
    assert shard.best(lexical.Query(0, np.array([0]), np.array([5])), 3)[0].tolist() == [0, 1, 2]


def test_no_rows(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lexical.search(docs, items).count() == lexical.search(some, items).count() == 0
    assert lexical.search(docs, some.withColumnRenamed("doc_id", "item_id")).count() == 0
