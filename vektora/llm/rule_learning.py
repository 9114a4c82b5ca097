"""Ordered rules by incremental reduced-error pruning (IREP).

For one kind after another, the rarest first, rules are grown on two thirds of what is left, adding
the condition with the highest FOIL gain until no other kind is covered, then pruned back on the
last third, and kept as long as they are right more often than not there.
"""

from __future__ import annotations

import numpy as np

#: At most so many thresholds are tried per feature: quantiles of its values.
CUTS = 64


def covers(x: np.ndarray, rule: list[tuple[int, str, float]]) -> np.ndarray:
    m = np.ones(len(x), bool)
    for j, op, t in rule:
        m &= x[:, j] <= t if op == "<=" else x[:, j] >= t
    return m


def grow(x: np.ndarray, y: np.ndarray, most: int) -> list[tuple[int, str, float]]:
    rule: list[tuple[int, str, float]] = []
    alive = np.ones(len(x), bool)
    while (y[alive] == 0).any() and len(rule) < most:
        p, n = y[alive].sum(), (~y[alive].astype(bool)).sum()
        base, best = np.log2(p / (p + n)), (1e-9, None)
        for j in range(x.shape[1]):
            v = x[alive, j]
            order = np.argsort(v, kind="stable")
            v, pos = v[order], np.cumsum(y[alive][order])
            ends = np.nonzero(np.r_[v[1:] != v[:-1], False])[0]  # the last place of each value but the highest
            if len(ends) > CUTS:
                ends = ends[np.linspace(0, len(ends) - 1, CUTS).astype(int)]
            for e in ends:
                t = float((v[e] + v[e + 1]) / 2)
                for op, pp, total in (("<=", pos[e], e + 1), (">=", pos[-1] - pos[e], len(v) - e - 1)):
                    if pp:
                        gain = pp * (np.log2(pp / total) - base)
                        if gain > best[0]:
                            best = (gain, (j, op, t))
        if best[1] is None:
            break
        rule.append(best[1])
        alive &= covers(x, [best[1]])
    return rule


def prune(rule: list[tuple[int, str, float]], x: np.ndarray, y: np.ndarray) -> list[tuple[int, str, float]]:
    def worth(r):
        m = covers(x, r)
        p = y[m].sum()
        return (2 * p - m.sum()) / m.sum() if m.any() else -1.0

    return max((rule[:i] for i in range(len(rule), 0, -1)), key=worth)


def learn(x: np.ndarray, kind: np.ndarray, features: tuple[str, ...], order: list[str] | None = None, least: int = 3, most: int = 8, seed: int = 7, sample: int = 20_000) -> list[dict]:
    """Rules for the kinds of `kind` other than "" (the default), learned on at most `sample` rows."""
    rng = np.random.default_rng(seed)
    if len(x) > sample:
        pick = rng.choice(len(x), sample, replace=False)
        x, kind = x[pick], kind[pick]
    names, counts = np.unique(kind[kind != ""], return_counts=True)
    rules, left = [], np.ones(len(x), bool)
    for name in order or list(names[np.argsort(counts, kind="stable")]):
        while True:
            at = np.nonzero(left)[0]
            y = (kind[at] == name).astype(int)
            if y.sum() < least:
                break
            third = rng.random(len(at)) < 1 / 3
            g, q = at[~third], at[third]
            if not (kind[g] == name).any():
                break
            rule = prune(grow(x[g], (kind[g] == name).astype(int), most), x[q], (kind[q] == name).astype(int))
            m = covers(x[q], rule)
            if not rule or not m.any() or (kind[q][m] == name).mean() <= 0.5:
                break
            tight = {(j, op): t for j, op, t in rule}  # a later condition on the same side is the tighter one
            rules.append({"if": [[features[j], op, round(t, 6)] for (j, op), t in tight.items()], "kind": name})
            left[at[covers(x[at], rule)]] = False
    return rules
