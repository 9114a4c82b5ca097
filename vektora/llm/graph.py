"""Connected groups of a link table, by rounds of merging towards the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vektora.session import Stored, materialize, materialize_counting


def flatten(parent: DataFrame) -> Stored:
    """Follow `parent` (node, up), which holds no cycle but loops, until every node names its root.

    A root is a node with up = node or without a row. Each round quadruples the reach, so the number
    of rounds is the logarithm of the depth."""
    jump = lambda t: t.join(t.select(F.col("node").alias("up"), F.col("up").alias("upper")), "up", "left").select("node", F.coalesce("upper", "up").alias("up"))
    now: Stored | None = None
    while True:
        t = jump(parent if now is None else now.df)
        further = t.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        nxt, moved = materialize_counting(t.join(further, "up", "left").select("node", F.coalesce("upper", "up").alias("up"), (F.coalesce("upper", "up") != F.col("up")).alias("moved")), "parent", F.col("moved"))
        if now is not None:
            now.drop()
        now = nxt
        if not moved:
            return now


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b); root is the smallest node of its group.

    Every round hooks each node to its smallest neighbour, flattens the hooks and contracts the
    links; what remains shrinks at least by half. The smallest of a hot node's neighbours is a
    partial minimum, never as a list. Nulls and loops are left out, an empty table gives no rows."""
    edges = materialize(links.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    members: Stored | None = None
    while edges.df.limit(1).count():
        both = edges.df.unionByName(edges.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up"))
        flat = flatten(hooks)
        f = flat.df.select("node", "up")
        if members is None:
            nxt = materialize(f.select("node", F.col("up").alias("root")), "members")
        else:
            nxt = materialize(members.df.join(f.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "members")
            members.drop()
        members = nxt
        more = materialize(
            edges.df.join(f.select(F.col("node").alias("a"), F.col("up").alias("ra")), "a")
            .join(f.select(F.col("node").alias("b"), F.col("up").alias("rb")), "b")
            .filter("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct(),
            "links",
        )
        edges.drop()
        flat.drop()
        edges = more
    if members is None:
        return edges.df.select(F.col("a").alias("node"), F.col("b").alias("root"))
    edges.drop()
    return members.df
