"""Bits per angle under a budget: small problems, solved on the driver from dim - 1 statistics."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

from vektora.functions.codecs import TIERS

#: The width that a tier's error is reckoned with, relative to the range.
STEP = {0: 1.0, 2: 1 / 4, 4: 1 / 16, 8: 1 / 256, 16: 2.0**-10, 32: 2.0**-23}


def distortion(bits: int, top: float) -> float:
    """Mean squared error of a uniform value in a bin of the tier's width."""
    return (top * STEP[bits]) ** 2 / 12


def greedy_tiers(sens: Sequence[float], tops: Sequence[float], budget: int) -> list[int]:
    """Tier bits of each angle: again and again the upgrade with the most error saved per bit that still fits.

    The saving per bit falls along each angle's ladder, so a heap of next steps sees the upgrades in
    their order; equal savings go to the smaller position. Steps that save nothing are not taken."""
    bits, left = [0] * len(sens), budget

    def step(i: int, at: int) -> tuple[float, int, int]:
        lo, hi = TIERS[at], TIERS[at + 1]
        return -sens[i] * (distortion(lo, tops[i]) - distortion(hi, tops[i])) / (hi - lo), i, at

    heap = [step(i, 0) for i in range(len(sens))]
    heapq.heapify(heap)
    while heap and left > 0:
        gain, i, at = heapq.heappop(heap)
        cost = TIERS[at + 1] - TIERS[at]
        if gain >= 0:
            break
        if cost > left:  # neither this nor a later step of this angle will fit
            continue
        bits[i], left = TIERS[at + 1], left - cost
        if at + 2 < len(TIERS):
            heapq.heappush(heap, step(i, at + 1))
    return bits


def proportional_bits(count: int, budget: int, std: Sequence[float] | None = None, low: int = 0, high: int = 16) -> list[int]:
    """Widths in proportion to importance that add up to the budget, as near to it as the bounds allow.

    Importance is the root of the number of coordinates an angle bears on or, given standard
    deviations, their log2 above the smallest plus 0.1. Every angle starts with the whole bits of its
    proportional share; what is over or short is settled in one pass over the sorted list of all
    single steps, the ones farthest from their share first, equal ones by position."""
    if std is None:
        weights = [math.sqrt(count - i) for i in range(count)]
    else:
        logs = [math.log2(max(float(x), 1e-6)) for x in std]
        weights = [x - min(logs) + 0.1 for x in logs]
    unit = budget / math.fsum(weights)
    share = [w * unit for w in weights]
    bits = [min(high, max(low, math.floor(x))) for x in share]
    short = budget - sum(bits)
    # (distance from the share after which the step comes, position): the step from b to b + 1, or to b - 1
    if short > 0:
        steps = sorted((round(b - share[i], 12), i) for i in range(count) for b in range(bits[i], high))
    else:
        steps = sorted((round(share[i] - b, 12), i) for i in range(count) for b in range(bits[i], low, -1))
    for _, i in steps[: abs(short)]:
        bits[i] += 1 if short > 0 else -1
    return bits
