"""The five most similar passage vectors of every passage vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vektora.llm.vector_index import build, nearest, usable

DIM, K = 64, 5
#: The pairs of p5_found have at least this cosine; their share found is calibrated to FOUND_RECALL.
CLOSE, FOUND_RECALL = 0.85, 0.9999
#: Calibrated share of correct answers among all five of every vector.
RECALL = 0.97


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return usable(spark.read.parquet(f"{sf}/chunk_vecs.parquet"), spark.read.parquet(f"{sf}/chunk_ids.parquet"), DIM, "corpus")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    index = build(vectors(spark, sf), DIM, FOUND_RECALL, CLOSE)
    near = nearest(index, K, CLOSE)
    index.drop_routed()
    return near.select(F.least("id", "other_id").alias("id_a"), F.greatest("id", "other_id").alias("id_b")).distinct()


def p5_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """(id, rank, other_id, cosine) of every usable vector."""
    index = build(vectors(spark, sf), DIM, RECALL)
    near = nearest(index, K)
    index.drop_routed()
    return near


def p5_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The same with every partition tried: the yardstick, in time quadratic in the rows."""
    near = nearest(build(vectors(spark, sf), DIM, None), K)
    return near.select("id", "rank", "other_id", F.round("cosine", 9).alias("cosine"))


QUERIES = {"p5_found": p5_found, "p5_neighbours": p5_neighbours, "p5_exact": p5_exact}
USABLE_SQL = """
v AS (SELECT ids AS id, min(vecs) AS v FROM (SELECT * FROM chunk_vecs WHERE split = 'corpus' AND len(vecs) = 64
  AND len(list_filter(vecs, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vecs, lambda x: x <> 0)) > 0)
  JOIN (SELECT DISTINCT * FROM chunk_ids WHERE ids IS NOT NULL) USING (dataset, split, chunk, pos) GROUP BY 1)"""
#: Every pair of vectors is compared: quick on the smaller tables only.
ORACLES = {
    "p5_found": f"""
WITH {USABLE_SQL},
c AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS c FROM v a JOIN v b ON a.id <> b.id),
r AS (SELECT a, b FROM c WHERE c >= 0.85 QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(c, 12) DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r""",
    "p5_exact": f"""
WITH {USABLE_SQL},
c AS (SELECT a.id AS id, b.id AS other_id, round(list_cosine_similarity(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])), 12) AS c FROM v a JOIN v b ON a.id <> b.id)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY c DESC, other_id) AS INTEGER) AS rank, other_id, round(c, 9) AS cosine FROM c QUALIFY rank <= 5""",
}
