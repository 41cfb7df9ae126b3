"""Fillings do the work: most large pieces are placed by them, in company, near the bound."""

import random

import pytest

from basewise.llm import packing


def check(plan, counts, size):
    """Every piece once, none over another, no gap."""
    filled, given = {}, {}
    for length, first, count, sequence, offset in plan.runs:
        assert first == given.get(length, 0)
        given[length] = first + count
        for i in range(count):
            filled.setdefault(sequence + i, []).append((offset, length))
    assert given == counts and len(filled) == plan.sequences
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size


@pytest.mark.parametrize("seed", range(4))
def test_fillings_place_most_large_pieces(seed):
    rng, counts = random.Random(seed), {}
    for _ in range(4000):
        n = min(2048, max(1, int(rng.lognormvariate(6, 0.9))))
        counts[n] = counts.get(n, 0) + 1
    plan = packing.make_plan(counts)
    check(plan, counts, 2048)
    large = sum(c for n, c in counts.items() if 2048 / 8 < n < 2048)
    bound = -(-sum(n * c for n, c in counts.items()) // 2048)
    assert plan.company > large / 2 and plan.sequences <= 1.006 * bound + 1


def test_odd_stocks():
    for counts in ({}, {1: 5}, {2048: 3}, {1025: 7}, {1024: 7, 1: 2}, {683: 100, 682: 100, 5: 1}, {700: 1}):
        plan = packing.make_plan(counts)
        check(plan, counts, 2048)
