"""Orphans against a loop over all pairs."""

import datetime as dt
import random

import pytest

from vektora.operators.referential import orphan_report, orphans, presence

T = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)


def brute(children, parents, match, timed):
    out = []
    for row in children:
        key, at = row[1:3], row[3]
        nulls = [k is None for k in key]
        if all(nulls) or (any(nulls) and match == "simple"):
            continue
        found = any(
            all(k is None or k == p for k, p in zip(key, par[:2])) and (not timed or (at is not None and par[2] is not None and par[2] <= at and (par[3] is None or at < par[3])))
            for par in parents
        )
        if not found or (any(nulls) and match == "full"):
            out.append(row)
    return sorted(out, key=str)


@pytest.mark.parametrize("match", ["simple", "partial", "full"])
@pytest.mark.parametrize("timed", [False, True])
def test_against_all_pairs(spark, match, timed):
    rng = random.Random(3)
    pick = lambda: rng.choice([None, "a", "b", "c"])
    kids = [(i, pick(), pick(), rng.choice([None, *(T(d) for d in range(9))]), "x") for i in range(150)]
    kids += kids[:10]  # repeated rows stay
    kids += [(1000 + i, "a", "a", T(i % 9), "hot") for i in range(200)]  # more than half share a key
    pars = [(pick(), pick(), rng.choice([None, T(rng.randrange(6))]), rng.choice([None, T(rng.randrange(9))])) for _ in range(12)]
    c = spark.createDataFrame(kids, "id int, k1 string, k2 string, t timestamp, start string")
    p = spark.createDataFrame(pars, "k1 string, k2 string, start timestamp, until timestamp")
    got = orphans(c, p, {"k1": "k1", "k2": "k2"}, match, *(("t", "start", "until") if timed else ()))
    assert got.columns == c.columns
    assert sorted(map(tuple, got.collect()), key=str) == brute(kids, pars, match, timed)


@pytest.mark.parametrize("rules", [{"k1": a, "k2": b} for a in ("holds", "unmatched", "ignored") for b in ("holds", "unmatched", "ignored")])
def test_rules_by_column(spark, rules):
    values = [None, "a", "b"]
    kids = [(i, x, y) for i, (x, y) in enumerate((x, y) for x in values for y in values)]
    pars = [("a", "a"), ("b", None), (None, "b")]

    def fails(x, y):
        null = {rules[c] for c, v in (("k1", x), ("k2", y)) if v is None}
        if "holds" in null or (x is None and y is None and "unmatched" not in null):
            return False
        return "unmatched" in null or not any((x is None or x == p) and (y is None or y == r) for p, r in pars)

    got = orphans(spark.createDataFrame(kids, "id int, k1 string, k2 string"), spark.createDataFrame(pars, "k1 string, k2 string"), {"k1": "k1", "k2": "k2"}, rules)
    assert sorted(r.id for r in got.collect()) == [i for i, x, y in kids if fails(x, y)]


def test_empty_tables_and_report(spark):
    c = spark.createDataFrame([(1, "a", T(0)), (2, None, T(40)), (3, "b", T(40)), (4, "b", None)], "id int, k string, t timestamp")
    none = spark.createDataFrame([], "k string, s timestamp, e timestamp")
    bad = orphans(c, none, {"k": "k"}, at="t", start="s", end="e")
    assert sorted(r.id for r in bad.collect()) == [1, 3, 4]
    assert sorted(((r.k, r.period, r.orphans) for r in orphan_report(bad, ["k"], "t").collect()), key=str) == [("a", "2024-01", 1), ("b", "2024-02", 1), ("b", None, 1)]
    assert orphans(c.limit(0), none, {"k": "k"}).count() == 0
    with pytest.raises(ValueError):
        orphans(c, none, {"k": "k"}, "other")
    with pytest.raises(ValueError):
        orphans(c, none, {"k": "k"}, {"k": "other"})


def test_presence_merges_reloads(spark):
    rows = [("a", T(0), T(5)), ("a", T(0), T(5)), ("a", T(3), T(8)), ("a", T(9), None), ("a", T(2), T(2)), ("b", None, T(3)), ("c", T(4), T(1))]
    p = presence(spark.createDataFrame(rows, "k string, s timestamp, e timestamp"), ["k"], "s", "e")
    assert sorted(map(tuple, p.collect())) == [("a", T(0), T(8)), ("a", T(9), None)]
