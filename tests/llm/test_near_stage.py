"""The near stage and its links against brute-force Jaccard."""

import itertools
import random

import pytest

import corpus_pipeline
from basewise.llm import super_minhash
from basewise.llm.common import table


def brute(texts):
    """``row -> smallest row of its component`` at five words and 0.8."""
    best = {i: i for i in range(len(texts))}
    sets = []
    for text in texts:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    near = {i: [] for i in best}
    for a, b in itertools.combinations(best, 2):
        both = len(sets[a] & sets[b])
        if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
            near[a].append(b)
            near[b].append(a)
    while (moved := {a: min([best[a], *(best[b] for b in near[a])]) for a in best}) != best:
        best = moved
    return best


def made():
    rng = random.Random(3)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randint(0, 60))
    out = [None, "", " ", "one two", "One  two", "one two three four five", "one two three four six"]
    line = [word() for _ in range(30)]
    for size, copies in ((12, 5), (60, 40), (200, 60), (900, 4)):
        base = [word() for _ in range(size)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, max(1, size // 40))):
                own[rng.randrange(size)] = word()
            out.append(" ".join(own))
    out += [" ".join(line + [word() for _ in range(rng.randint(1, 12))]) for _ in range(50)]  # a common passage
    chain = [word() for _ in range(80)]
    for i in range(25):  # a chain, its ends unlike
        chain[3 * i] = word()
        out.append(" ".join(chain))
    return out + [" ".join(word() for _ in range(rng.randint(1, 90))) for _ in range(40)]


@pytest.mark.parametrize("crowd", [1, 16])
def test_links_as_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(super_minhash, "CROWD", crowd)
    texts = made()
    best = brute(texts)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, token string").repartition(3)
    got = {r.id: r.component_id for r in super_minhash.near_groups(docs, least=0.8, empty_linked=True).collect()}
    assert got == best and 20 < len(set(best.values())) < len(texts)


def test_near_stage_drops_near_copies(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    best = brute([r.text for r in rows])
    kept = sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").collect())
    assert kept == [rows[i].doc_id for i in sorted(set(best.values()))]
    assert not {2, 56} <= set(kept)


def test_no_rows(spark):
    assert super_minhash.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
