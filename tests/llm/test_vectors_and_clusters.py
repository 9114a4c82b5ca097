"""The vector index and linkage against brute force."""

import numpy as np
import oracle
import pytest

from vektora.llm import p3_clusters as p3
from vektora.llm import p5_neighbours as p5
from vektora.llm import vector_index as vi
from vektora.llm.linkage import reciprocal_linkage, spanning

DIM = 16


def cloud(seed=1, clusters=40, loose=300):
    """Tight groups, loose vectors, scaled and exact copies."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(clusters):
        c = rng.normal(size=DIM)
        rows += [c + 0.15 * rng.normal(size=DIM) for _ in range(rng.integers(2, 14))]
    rows += list(rng.normal(size=(loose, DIM)))
    rows += [rows[0]] * 12 + [rows[1] * 3.5, rows[2] * 1e-3]
    m = np.array(rows, np.float32)
    return [f"i{j:04}" for j in rng.permutation(len(m))], m


def frame(spark, ids, m):
    return spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, m)], "id string, v array<float>")


def brute(ids, m, k):
    u = vi.unit(m)
    c = np.round(np.minimum(u @ u.T, 1.0), 12)
    out = {}
    for a in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != a), key=lambda j: (-c[a, j], ids[j]))
        out[ids[a]] = [(ids[j], c[a, j]) for j in order[:k]]
    return out


@pytest.mark.parametrize("least, rows", [(None, 10_000), (0.85, 10_000), (None, 60), (0.85, 60)])
def test_exact(spark, least, rows):
    """One partition, and trying every partition."""
    ids, m = cloud()
    near = vi.nearest(vi.build(frame(spark, ids, m), DIM, None, least, rows=rows), 5, least)
    got = {}
    for r in near.orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.other_id, r.cosine))
    for i, want in brute(ids, m, 5).items():
        want = [w for w in want if least is None or w[1] >= least]
        have = got.get(i, [])
        assert [round(c, 9) for _, c in have] == pytest.approx([round(c, 9) for _, c in want])
        assert len({o for o, _ in have}) == len(have) and i not in {o for o, _ in have}


def hits(near, want):
    got = {}
    for r in near.collect():
        got.setdefault(r.id, set()).add(round(r.cosine, 9))
    return np.array([sum(round(c, 9) in got.get(i, ()) for _, c in w) for i, w in want.items()])


@pytest.mark.parametrize("settings", [{"rows": 100}, {"rows": 100, "fanout": 4, "refine": 150}, {"rows": 40, "fanout": 3, "refine": 60}])
def test_partitions_reach_the_recall(spark, monkeypatch, settings):
    """One, two and more levels of classifiers; partitions are cut into several blocks."""
    monkeypatch.setattr(vi, "BLOCK", 64)
    monkeypatch.setattr(vi, "SEARCHERS", 200)
    ids, m = cloud(2, 80, 600)
    want = brute(ids, m, 5)
    index = vi.build(frame(spark, ids, m), DIM, 0.97, **settings)
    tried = index.routed[0].df.selectExpr("avg(aggregate(visits, 0, (a, x) -> a + size(x.leaves)))").first()[0]
    assert index.partitions >= 8 and tried < len(index.router.b)
    assert len(index.routed) > 2 or "fanout" not in settings
    found = hits(vi.nearest(index, 5), want)
    assert found.sum() / (5 * len(ids)) >= 0.9
    close = {(i, o) for i, w in want.items() for o, c in w if c >= 0.85}
    near = {(r.id, r.other_id) for r in vi.nearest(vi.build(frame(spark, ids, m), DIM, 0.9995, 0.85, **settings), 5, 0.85).collect()}
    assert len(near & close) >= 0.98 * len(close) and not near - close


def test_recall_on_a_test_table(spark):
    """p5_neighbours with its own settings against brute force over all passage vectors of sf0.1."""
    v = p5.vectors(spark, "/root/testdata/sf0.1").toArrow()
    ids, m = v["id"].to_pylist(), vi.matrix(v["v"], p5.DIM)
    u = vi.unit(m)
    kth = np.concatenate([np.partition(np.round(np.minimum(u[i : i + 1000] @ u.T, 1.0), 12), -6, axis=1)[:, -6] for i in range(0, len(u), 1000)])
    place = {x: i for i, x in enumerate(ids)}
    near = p5.p5_neighbours(spark, "/root/testdata/sf0.1").select("id", "cosine").toArrow()
    at = np.array([place[x] for x in near["id"].to_pylist()])
    right = np.bincount(at[near["cosine"].to_numpy() >= kth[at] - 1e-12], minlength=len(u))
    assert (np.bincount(at, minlength=len(u)) == 5).all()
    assert right.clip(max=5).mean() / 5 >= 0.95 and (right < 3).mean() < 0.02


def test_balanced_partition_and_margin():
    rng = np.random.default_rng(3)
    u = vi.unit(rng.normal(size=(800, DIM)))
    near, sims = vi.neighbours(u, 10)
    assert (np.sort(sims, axis=1)[:, -1] >= np.sort(sims, axis=1)[:, 0]).all()
    label = vi.balanced_partition(u, near, 8)
    assert np.bincount(label, minlength=8).max() <= np.ceil(800 / 8 * 1.05)
    r = vi.fit(u.astype(np.float32), 8, 0.9, group=2)
    assert r.expected >= 0.9 and r.margin > 0 and len(set(r.group.tolist())) == 4
    assert np.isinf(vi.fit(u.astype(np.float32), 8, None).margin)


def test_usable(spark):
    rows = [("d", "corpus", "c", i, v) for i, v in enumerate([[1.0, 2.0], None, [], [1.0], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], [3.0, 4.0], [5.0, 6.0]])]
    v = spark.createDataFrame([*rows, ("d", "queries", "c", 0, [1.0, 1.0])], "dataset string, split string, chunk string, pos int, vecs array<float>")
    n = spark.createDataFrame([("d", "corpus", "c", i, f"i{i}" if i != 8 else None) for i in range(10)] * 2 + [("d", "queries", "c", 0, "q")], "dataset string, split string, chunk string, pos int, ids string")
    assert sorted((r.id, r.v) for r in vi.usable(v, n, 2, "corpus").collect()) == [("i0", [1.0, 2.0]), ("i9", [5.0, 6.0])]
    empty = vi.build(vi.usable(v.limit(0), n, 2), 2, 0.9)
    assert vi.nearest(empty, 5).count() == 0 and p3.clusters(empty).count() == 0


def groups_of(ids, m, least):
    u = vi.unit(m)
    link = (u @ u.T) >= least
    left, out = set(range(len(ids))), set()
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            a = todo.pop()
            seen.add(a)
            new = set(np.nonzero(link[a])[0].tolist()) & left
            left -= new
            todo += new
        if len(seen) >= 3:
            out |= {(min(ids[a] for a in seen), ids[a]) for a in seen}
    return out


@pytest.mark.parametrize("rows, block", [(10_000, 16_384), (10_000, 50), (100, 100)])
def test_clusters(spark, monkeypatch, rows, block):
    monkeypatch.setattr(vi, "BLOCK", block)
    monkeypatch.setattr(vi, "SEARCHERS", 3 * block)
    ids, m = cloud(4, 60, 200)
    chain = [np.r_[np.cos(a), np.sin(a), np.zeros(DIM - 2)] for a in np.arange(0, 2.5, 0.3)]  # neighbours are linked, the ends aren't
    m = np.vstack([m, chain]).astype(np.float32)
    ids += [f"z{i}" for i in range(len(chain))]
    found = p3.clusters(vi.build(frame(spark, ids, m), DIM, None if rows > 100 else 0.9999, 0.85, rows=rows))
    assert {(r.cluster_id, r.member_id) for r in found.collect()} == groups_of(ids, m, 0.85)
    about = {r.cluster_id: r for r in p3.describe(found, frame(spark, ids, m), DIM).collect()}
    assert about["z0"].size == len(chain) and about["z0"].typical[0] == "z4"


def plain_average(links, threshold, missing):
    """Average linkage of mutual best pairs, cluster by cluster."""
    sim = {}
    for a, b, s in links:
        sim[frozenset((a, b))] = max(s, sim.get(frozenset((a, b)), -9))
    groups = {x: {x} for p in sim for x in p}

    def mean(g, h):
        known = [sim[k] for a in g for b in h if (k := frozenset((a, b))) in sim]
        if not known:
            return -9
        if missing is None:
            return sum(known) / len(known)
        return (sum(known) + missing * (len(g) * len(h) - len(known))) / (len(g) * len(h))

    while True:
        best = {}
        for x in groups:
            options = [(-m, min(x, y), max(x, y), y) for y in groups if y != x and (m := mean(groups[x], groups[y])) >= threshold]
            if options:
                best[x] = min(options)[3]
        pairs = {(x, y) for x, y in best.items() if best.get(y) == x and x < y}
        if not pairs:
            return {(n, min(g)) for g in groups.values() if len(g) > 1 for n in g}
        for x, y in pairs:
            groups[x] |= groups.pop(y)


def some_links(seed, low):
    rng = np.random.default_rng(seed)
    return [(int(a), int(b), round(float(s), 3)) for a, b, s in zip(rng.integers(0, 25, 60), rng.integers(0, 25, 60), rng.uniform(low, 1, 60)) if a != b]


@pytest.mark.parametrize("missing", [0.0, 0.4, None])
def test_average_linkage(spark, missing):
    links = some_links(6, 0.3)
    df = spark.createDataFrame([*links, (1, 1, 1.0), (None, 2, 1.0), (3, 4, None)], "a bigint, b bigint, s double")
    got = {tuple(r) for r in reciprocal_linkage(df, 0.5, missing).collect()}
    assert got == plain_average(links, 0.5, missing)
    assert reciprocal_linkage(df.limit(0), 0.5).count() == 0


@pytest.mark.parametrize("tolerance", [0.0, 0.01, 0.2])
def test_links_at_the_threshold_give_connected_groups(spark, tolerance):
    links = some_links(8, 0.5) + [(100, x, 0.9) for x in range(101, 110)] + [(200 + x, 201 + x, 0.6) for x in range(6)]
    got = {tuple(r) for r in reciprocal_linkage(spark.createDataFrame(links, "a bigint, b bigint, s double"), 0.5, None, tolerance).collect()}
    root = {x: x for a, b, _ in links for x in (a, b)}
    for _ in root:
        for a, b, _ in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {(x, r) for x, r in root.items()}


def test_spanning_forest():
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 40, 300), rng.integers(0, 40, 300)
    a, b = a[a != b], b[a != b]
    s = np.round(rng.uniform(size=len(a)), 2)
    keep = spanning(a, b, s, 40)

    def kruskal():
        p, total, n = list(range(40)), 0.0, 0

        def find(x):
            while p[x] != x:
                x = p[x]
            return x

        for i in np.argsort(-s, kind="stable"):
            x, y = find(a[i]), find(b[i])
            if x != y:
                p[x] = y
                total, n = total + s[i], n + 1
        return round(total, 6), n

    assert (round(s[keep].sum(), 6), len(keep)) == kruskal()
    assert len(spanning(a[:0], b[:0], s[:0], 5)) == 0


def test_queries(spark, sf):
    for module in (p3, p5):
        for name, sql in module.ORACLES.items():
            assert not oracle.same(module.QUERIES[name](spark, sf), sql, sf)[1], name
    near = p5.p5_neighbours(spark, sf)
    assert near.columns == ["id", "rank", "other_id", "cosine"] and near.count() > 0
