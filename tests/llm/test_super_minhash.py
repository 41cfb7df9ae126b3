"""SuperMinHash: signatures against a set-by-set version, groups against brute-force Jaccard."""

import itertools
import random

import numpy as np
import pytest
from test_near_stage import made

from basewise.llm import super_minhash


def slow_signature(hashes, places):
    """One shingle after the other, each place the least of all offers."""
    values = [None] * places
    for h in hashes:
        order = list(range(places))
        for step in range(places):
            drawn = int(super_minhash._mixed(np.array([h], np.uint64) + np.uint64((step + 1) * int(super_minhash._STEP) % 2**64))[0])
            at = step + ((drawn & 0xFFFFFFFF) * (places - step) >> 32)
            order[step], order[at] = order[at], order[step]
            offer = step << 32 | drawn >> 32
            if values[order[step]] is None or offer < values[order[step]]:
                values[order[step]] = offer
    return values


def test_signatures_as_without_early_stop(monkeypatch):
    monkeypatch.setattr(super_minhash, "BLOCK", 50)
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 2, 7, 40, 130, 0, 300)]
    got = super_minhash.signatures(sets, 16)
    for own, values in zip(sets, got):
        assert values.tolist() == (slow_signature(own.tolist(), 16) if len(own) else [2**64 - 1] * 16)


def test_agreement_estimates_similarity():
    rng = np.random.default_rng(6)
    shared = rng.integers(0, 2**63, 900).astype(np.uint64)
    a, b = (np.concatenate([shared[:170 * 5], rng.integers(0, 2**63, 75).astype(np.uint64)]) for _ in range(2))
    x, y = super_minhash.signatures([a, b], 4096)
    assert abs((x == y).mean() - 850 / 1000) < 0.03
    assert super_minhash.bands_for(0.85) == 29 and super_minhash.bands_for(0.8) == 40


def groups(texts, least, empty):
    """Ids are the places in ``texts``; words are runs without ASCII white space."""
    sets = []
    for text in texts:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    best = list(range(len(texts)))
    near = [(a, b) for a, b in itertools.combinations(best, 2)
            if (sets[a] or sets[b] or empty) and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    while True:
        old = list(best)
        for a, b in near:
            best[a] = best[b] = min(best[a], best[b])
        if old == best:
            return best, [len(s) for s in sets]


@pytest.mark.parametrize("crowd", [1, 16])
def test_groups_as_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(super_minhash, "CROWD", crowd)
    rng = random.Random(11)
    texts = made() + [None, "\t", "Same TEXT here", "same text\nhere", "long " * 30_000]
    common = [f"c{i}" for i in range(40)]  # one passage in a third of all texts
    texts += [" ".join(common + [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 9))]) for _ in range(100)]
    best, sizes = groups(texts, 85, False)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, row string, size string")
    got = {r.id: (r.size, r.component_id, r.keep_row is not None) for r in super_minhash.near_groups(docs.repartition(4)).collect()}
    assert got == {i: (n, b, True) for i, (n, b) in enumerate(zip(sizes, best))}


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (7, text), (7, text + " end"), (3, None), (3, ""), (None, " "), (9, "only one")]
    got = super_minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.id), r.size, str(r.component_id)) for r in got) == sorted(
        [("None", 46, "7"), ("7", 46, "7"), ("7", 47, "7"), ("3", 0, "3"), ("3", 0, "3"), ("None", 0, "None"), ("9", 1, "9")])
    assert len({r.keep_row for r in got}) == 5
