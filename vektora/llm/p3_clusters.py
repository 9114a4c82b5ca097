"""Groups of passage vectors that are linked by similarity, and what is typical of each.

The groups asked for are chained by links, whatever their shape. Average linkage of mutual best
pairs gives exactly these on the graph of links: the mean of some links at the threshold or above
is no lower, so that merging goes on while a link is left between two clusters.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vektora.llm.linkage import reciprocal_linkage, spanning
from vektora.llm.p5_neighbours import DIM, USABLE_SQL, vectors
from vektora.llm.vector_index import Index, Top, blockwise, build, meetings
from vektora.session import materialize

LINK, LEAST_SIZE, RECALL, TYPICAL = 0.85, 3, 0.9999, 3
#: Links kept per vector and block beside the spanning forest; best pairs within this of each other merge in one round.
NEAREST, TOLERANCE = 5, 0.005


def links_in_block(table, dim: int, threshold: float, k: int = NEAREST):
    """(a, b, s): of the links of a block, each row's k most similar and a maximum spanning forest.

    The forest so far joins the links as they come, so memory stays bounded however dense the block
    is, and no two rows that links connect come apart."""
    nodes: list = []
    rows = len(np.unique(table.column("n").to_numpy()))
    top, all_ = Top(rows, k, threshold), np.full(rows, threshold - 1e-5, np.float32)
    a, b, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for x, y, cos in meetings(table, dim, k, lambda: all_, nodes):
        near = cos >= threshold
        x, y, cos = x[near], y[near], cos[near]
        top.offer(x, y, cos)
        a, b, s = np.concatenate([a, x]), np.concatenate([b, y]), np.concatenate([s, cos])
        if len(a) > 4 * rows + 10_000:
            keep = spanning(a, b, s, rows)
            a, b, s = a[keep], b[keep], s[keep]
    keep = spanning(a, b, s, rows)
    top.settle()
    a, b, s = (np.concatenate(z) for z in zip((a[keep], b[keep], s[keep]), top.held, strict=True))
    a, b = np.minimum(a, b), np.maximum(a, b)
    _, first = np.unique(a * max(rows, 1) + b, return_index=True)
    return nodes[0][a[first]], nodes[0][b[first]], s[first]


def sparse_links(index: Index, threshold: float) -> DataFrame:
    """(a, b, s) over the indexed classes: at most NEAREST + 1 links per row and block, enough for every group."""
    dim = index.dim

    def run(table):
        import pyarrow as pa

        a, b, s = links_in_block(table, dim, threshold)
        return pa.table({"a": a.astype(np.int64), "b": b.astype(np.int64), "s": s})

    return blockwise(index).groupBy("g", "mb", "qs").applyInArrow(run, "a bigint, b bigint, s double")


def clusters(index: Index, threshold: float = LINK, least: int = LEAST_SIZE) -> DataFrame:
    """(cluster_id, member_id) of every group of at least `least` ids; cluster_id is the smallest id."""
    links = materialize(sparse_links(index, threshold), "links")
    grouped = reciprocal_linkage(links.df, threshold, None, TOLERANCE)
    links.drop()
    # n follows the order of the ids, so the smallest n is the smallest id; ids of equal vectors belong together
    each = index.members.df.join(grouped.withColumnRenamed("node", "n"), "n", "left").select("id", F.coalesce("root", "n").alias("root"))
    size = each.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("cluster_id")).filter(F.col("size") >= least)
    return each.join(size, "root").select("cluster_id", F.col("id").alias("member_id"))


def describe(found: DataFrame, vectors: DataFrame, dim: int, typical: int = TYPICAL) -> DataFrame:
    """(cluster_id, size, typical): the members closest to the mean direction of each cluster, equal ones by id.

    The means are partial sums; only `typical` members per cluster are put together."""
    v = found.join(vectors.select(F.col("id").alias("member_id"), "v"), "member_id")
    peak = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x).cast("double")))
    v = v.withColumn("m", peak).withColumn("x", F.transform("v", lambda x: x / F.col("m"))).withColumn("l", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, x: a + x * x)))
    v = v.select("cluster_id", "member_id", F.transform("x", lambda x: x / F.col("l")).alias("u"))
    means = v.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), *(F.sum(F.col("u")[i]).alias(f"s{i}") for i in range(dim)))
    means = means.select("cluster_id", "size", F.array(*(f"s{i}" for i in range(dim))).alias("c"))
    near = v.join(means, "cluster_id").withColumn("cos", F.round(F.aggregate(F.zip_with("u", "c", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x), 9))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("cos"), "member_id")
    top = near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= typical)
    return top.groupBy("cluster_id").agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("r", "member_id"))).alias("t")).select("cluster_id", "size", F.col("t.member_id").alias("typical"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    index = build(vectors(spark, sf), DIM, RECALL, LINK)
    found = clusters(index)
    index.drop_routed()
    return found


def p3_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return describe(p3_found(spark, sf), vectors(spark, sf), DIM)


QUERIES = {"p3_found": p3_found, "p3_clusters": p3_clusters}
#: All pairs and all ways through them: quick on the smaller tables only.
ORACLES = {
    "p3_found": f"""
WITH RECURSIVE {USABLE_SQL},
e AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id WHERE round(list_cosine_similarity(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])), 12) >= {LINK}),
r AS (SELECT id, id AS other FROM v UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a)
SELECT min(other) AS cluster_id, id AS member_id FROM r GROUP BY id HAVING count(*) >= {LEAST_SIZE}""",
}
_UNIT = "list_transform(x, lambda y: y / sqrt(list_sum(list_transform(x, lambda z: z * z))))"
#: From the groups, each member's cosine with the mean direction of its group.
ORACLES["p3_clusters"] = f"""{ORACLES["p3_found"].rsplit("SELECT min(other)", 1)[0].rstrip()},
f AS (SELECT min(other) AS cluster_id, id FROM r GROUP BY id HAVING count(*) >= {LEAST_SIZE}),
u AS (SELECT cluster_id, id, {_UNIT} AS u FROM (SELECT cluster_id, id, list_transform(v, lambda y: CAST(y AS DOUBLE) / list_max(list_transform(v, lambda z: abs(CAST(z AS DOUBLE))))) AS x FROM f JOIN v USING (id))),
c AS (SELECT cluster_id, i, sum(u[i]) AS s FROM u, range(1, {DIM + 1}) t(i) GROUP BY ALL), m AS (SELECT cluster_id, list(s ORDER BY i) AS c FROM c GROUP BY 1),
o AS (SELECT cluster_id, id, count(*) OVER (PARTITION BY cluster_id) AS size, row_number() OVER (PARTITION BY cluster_id ORDER BY round(list_dot_product(u, c), 9) DESC, id) AS place FROM u JOIN m USING (cluster_id))
SELECT cluster_id, any_value(size) AS size, list(id ORDER BY place) AS typical FROM o WHERE place <= {TYPICAL} GROUP BY 1"""
