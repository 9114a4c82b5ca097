"""The registry's counts and costs, and the allocators."""

import random

import pytest

from vektora.functions.vectors import ranges
from vektora.operators import allocation, schemes
from vektora.plans.vector_queries import KNOWN_ALIASES, KNOWN_BITS

#: Published costs at 384 numbers: fixed values.
AT_384 = {"float32": 12288, "cart_int8": 3072, "angle_int8_uniform": 3064, "cart_clip_20pct": 2456, "pos_clip_20pct": 2448, "jac_trunc_int8_keep70pct": 2144, "cart_clip_40pct": 1840, "cart_clip_80pct": 616, "pos_clip_80pct_zero": 616, "jac_trunc_int2_keep30pct": 230, "greedy_12288b": 12256}


def test_counts_costs_and_aliases():
    for dim in (1536, 64):
        every = schemes.registry(dim)
        kept, alias = schemes.distinct(every)
        assert (len(every), len(alias), len(kept)) == (53, 8, 45)
    bits = {s.name: s.bits_per_vec for s in schemes.registry(1536)}
    assert all(bits[n] == b for n, b in KNOWN_BITS)
    assert schemes.distinct(schemes.registry(1536))[1] == dict(KNOWN_ALIASES)
    at = {s.name: s.bits_per_vec for s in schemes.registry(384)}
    assert all(at[n] == b for n, b in AT_384.items())


def by_sorted_steps(sens, tops, budget):
    """The list of all steps of all ladders, the most gain per bit first; each is taken if it is its angle's next and fits."""
    ladder = list(zip(allocation.TIERS, allocation.TIERS[1:]))
    gain = lambda i, lo, hi: sens[i] * (allocation.distortion(lo, tops[i]) - allocation.distortion(hi, tops[i])) / (hi - lo)
    steps = sorted((-gain(i, lo, hi), i, lo, hi) for i in range(len(sens)) for lo, hi in ladder)
    bits = [0] * len(sens)
    for worth, i, lo, hi in steps:
        if worth < 0 and bits[i] == lo and sum(bits) + hi - lo <= budget:
            bits[i] = hi
    return bits


def test_greedy_tiers_like_the_sorted_steps():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randrange(2, 20)
        sens = sorted((rng.choice([rng.random(), 0.0, 1.0]) for _ in range(n)), reverse=True)
        budget = rng.randrange(0, 40 * n)
        got = allocation.greedy_tiers(sens, ranges(n + 1), budget)
        assert got == by_sorted_steps(sens, ranges(n + 1), budget) and sum(got) <= budget


def farthest_first(count, budget, std, high=16):
    """Every multiset of single steps is tried: the one whose widths lie nearest to the shares, position by position."""
    import itertools
    import math

    w = [math.sqrt(count - i) for i in range(count)] if std is None else [math.log2(x) - min(map(math.log2, std)) + 0.1 for x in std]
    share = [x * budget / sum(w) for x in w]
    start = [min(high, math.floor(x)) for x in share]
    options = [b for b in itertools.product(*(range(s, high + 1) for s in start)) if sum(b) == budget]
    return min(options, key=lambda b: sum((x - y) ** 2 for x, y in zip(b, share)))


@pytest.mark.parametrize("count, budget, std", [(3, 11, None), (4, 17, None), (4, 23, [0.1, 0.5, 0.3, 0.9]), (3, 29, [0.2, 0.7, 0.9])])
def test_proportional_bits_are_nearest_to_the_shares(count, budget, std):
    assert allocation.proportional_bits(count, budget, std) == list(farthest_first(count, budget, std))


def test_proportional_bits():
    assert sum(allocation.proportional_bits(63, 252)) == 252
    assert allocation.proportional_bits(4, 1000) == [16] * 4
    assert allocation.proportional_bits(4, 0) == [0] * 4
    assert sum(allocation.proportional_bits(5, 20, [0.1, 0.2, 0.3, 0.4, 1.0])) == 20


@pytest.mark.parametrize("dim, percent, keep", [(1536, 50, 768), (384, 50, 192), (64, 50, 32)])
def test_kept_counts(dim, percent, keep):
    assert next(s.keep for s in schemes.registry(dim) if s.name == f"pos_clip_{percent}pct") == keep
