"""Similarity clusters by merging mutual best pairs in rounds on a sparse graph.

Reciprocal nearest neighbours with average linkage: in each round every two clusters that are each
other's most similar one merge, all in parallel, until no similarity reaches the threshold. The
similarity of two clusters is the mean over the pairs of their members; a pair that the sparse graph
lacks counts as `missing`, or not at all where `missing` is None, as in a graph of nearest
neighbours, which says nothing of other pairs.

Similarities that differ by no more than `tolerance` count as equally good, so that a cluster may
merge with several best partners in one round. Without it only pairs merge, and a cluster that many
others have as their best takes a round for each of them.

With links all at the threshold or above and missing=None, the means of links never fall below it,
so that every linked pair of clusters merges in the end: the clusters are the connected groups,
whatever the order and the tolerance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vektora.llm.graph import flatten
from vektora.session import materialize, materialize_counting


def reciprocal_linkage(links: DataFrame, threshold: float, missing: float | None = 0.0, tolerance: float = 0.0) -> DataFrame:
    """(node, root) for every node of `links` (a, b, s) in a cluster of two or more; root is its smallest node.

    Links may be given in either direction and more than once (the highest counts); loops and nulls
    are left out. Equal similarities are decided by the smaller nodes where tolerance is 0. No links
    give no rows."""
    given = links.filter("a is not null and b is not null and a <> b and s is not null")
    edges = materialize(given.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("s").alias("s"), F.lit(1).cast("bigint").alias("c")), "edges")
    start = edges.df.select(F.col("a").alias("node")).union(edges.df.select("b")).distinct()
    members, merged = materialize(start.select("node", F.col("node").alias("root")), "members"), []

    def settle() -> None:
        """Bring the members up to date with the mergers of the last rounds."""
        nonlocal members
        now = members.df
        for f in merged:
            now = now.join(f.df.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        nxt = materialize(now, "members")
        for old in (members, *merged):
            old.drop()
        merged.clear()
        members = nxt

    while True:
        e = edges.df
        if missing is None:
            e = e.withColumn("m", F.col("s") / F.col("c"))
        else:
            size = members.df.groupBy(F.col("root").alias("a")).agg(F.count(F.lit(1)).alias("na"))
            e = e.join(size, "a").join(size.select(F.col("a").alias("b"), F.col("na").alias("nb")), "b")
            pairs = F.col("na") * F.col("nb")
            e = e.withColumn("m", (F.col("s") + missing * (pairs - F.col("c"))) / pairs)
        e = e.filter(F.col("m") >= threshold - 1e-12).select("a", "b", "m")
        both = e.select(F.col("a").alias("node"), "m", "a", "b").unionByName(e.select(F.col("b").alias("node"), "m", "a", "b"))
        if tolerance:
            best = both.groupBy("node").agg((F.max("m") - tolerance).alias("low"))
            side = lambda c: best.select(F.col("node").alias(c), F.col("low").alias(f"low_{c}"))
            mutual = e.join(side("a"), "a").join(side("b"), "b").filter((F.col("m") >= F.col("low_a")) & (F.col("m") >= F.col("low_b")))
        else:
            # one order over all pairs: of equal ones the smaller (a, b); min() keeps it a partial aggregation
            best = both.groupBy("node").agg(F.min(F.struct((-F.col("m")).alias("m"), "a", "b")).alias("t"))
            mutual = best.groupBy("t.a", "t.b").agg(F.count(F.lit(1)).alias("n")).filter("n = 2")
        hooks, some = materialize_counting(mutual.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), "hooks")  # a < b
        if not some:
            hooks.drop()
            break
        if tolerance:  # hooks may form chains; pairs can't
            flat = flatten(hooks.df)
            hooks.drop()
            hooks = flat
        f = hooks.df.select("node", "up")
        ends = edges.df.join(f.select(F.col("node").alias("a"), F.col("up").alias("ra")), "a", "left").join(f.select(F.col("node").alias("b"), F.col("up").alias("rb")), "b", "left")
        ends = ends.select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"), "s", "c").filter("x <> y")
        more = materialize(ends.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("s").alias("s"), F.sum("c").alias("c")), "edges")
        edges.drop()
        edges = more
        merged.append(hooks)
        if missing is not None or len(merged) == 8:  # the sizes are needed at once, or the plan gets long
            settle()
    settle()
    edges.drop()
    size = members.df.groupBy("root").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")  # a root is its cluster's smallest node
    return members.df.join(size, "root").select("node", "root")


def spanning(a, b, s, nodes: int):
    """Places of a maximum spanning forest's links among links (a, b, s) between nodes 0 .. nodes - 1.

    Every dropped link closes a cycle of links at least as similar, so what is linked stays linked at
    every level. Rounds of best links, in NumPy."""
    import numpy as np

    order = np.lexsort((np.maximum(a, b), np.minimum(a, b), -s))
    a, b = a[order], b[order]
    label, alive, kept = np.arange(nodes), np.arange(len(a)), []
    while len(alive):
        x, y = label[a[alive]], label[b[alive]]
        alive = alive[x != y]
        if not len(alive):
            break
        x, y = label[a[alive]], label[b[alive]]
        first = np.full(nodes, len(a), np.int64)
        np.minimum.at(first, x, alive)
        np.minimum.at(first, y, alive)
        use = np.unique(first[first < len(a)])
        kept.append(use)
        x, y = label[a[use]], label[b[use]]
        up = np.arange(nodes)
        while True:  # join the groups of the chosen links, the smaller label wins
            lo, hi = np.minimum(up[x], up[y]), np.maximum(up[x], up[y])
            if (lo == hi).all():
                break
            np.minimum.at(up, hi, lo)
            while (up[up] != up).any():
                up = up[up]
        label = up[label]
    return order[np.concatenate(kept)] if kept else np.zeros(0, np.int64)
