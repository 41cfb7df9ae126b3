"""A large group of near copies: its links are found without comparing all of its texts with each other."""

import itertools
import random

from basewise.llm import jaccard, super_minhash


def test_near_copies_meet_their_middle(spark, monkeypatch):
    rng = random.Random(23)
    copies = iter(range(10**6))

    def changed(words, places):  # each place takes five shingles and gives five new ones
        own = list(words)
        for at in rng.sample(range(5, len(words) - 5), places):
            own[at] = f"x{next(copies)}"
        return own

    base = [f"w{i}" for i in range(150)]
    middles = [base, changed(base, 4)]  # two groups, not linked
    texts = [" ".join(t) for m in middles for t in [m, *(changed(m, rng.choice((1, 2, 2, 3, 4))) for _ in range(200))]]
    rng.shuffle(texts)
    sets = [jaccard.shingles(t) for t in texts]
    best = list(range(len(texts)))
    near = [(a, b) for a, b in itertools.combinations(best, 2) if jaccard.similar(sets[a], sets[b], 0.85)]
    old = None
    while old != best:
        old = list(best)
        for a, b in near:
            best[a] = best[b] = min(best[a], best[b])
    compared = []

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verified(pairs, *rest)

    verified = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", counted)
    monkeypatch.setattr(super_minhash, "verified", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.id: r.component_id for r in super_minhash.near_groups(docs).collect()}
    assert got == dict(enumerate(best))
    assert 2 < len(set(best)) < len(texts) // 2 < len(near)
    assert compared[-1] < len(texts), compared  # after the turns with hubs
