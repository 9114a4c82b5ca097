"""Retrieval quality from ranked rows and graded judgements.

Judged queries only; relevant documents that aren't in the corpus still count in the ideal ranking and
in the denominator of recall. A query without results scores 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def positive(qrels: DataFrame, order: str | None = None) -> DataFrame:
    """(query_id, corpus_id, score) with score > 0; of repeated pairs the last by `order`, else the highest score."""
    q = qrels.filter("query_id is not null and corpus_id is not null")
    pick = F.max_by("score", order) if order else F.max("score")
    return q.filter("score > 0").groupBy("query_id", "corpus_id").agg(pick.alias("score"))


def _gain(rank: str):
    return F.col("score") / F.log2(F.col(rank) + 1)


def ideal(qrels: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(query_id, relevant, idcg@k...)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_id")
    r = qrels.withColumn("place", F.row_number().over(w))
    return r.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"), *(F.sum(F.when(F.col("place") <= k, _gain("place"))).alias(f"idcg{k}") for k in ks))


def per_query(ranking: DataFrame, qrels: DataFrame, by: Sequence[str] = ("scheme",), ks: Sequence[int] = (5, 10, 15, 20), recall: int = 100, asked: DataFrame | None = None) -> DataFrame:
    """(by..., query_id, ndcg<k>..., recall<k>) for every judged query, 0 for one without results.

    ranking: (by..., query_id, doc_id, rank from 1); qrels: distinct positive (query_id, corpus_id,
    score). Judged queries are those of qrels or, with `asked` (query_id), those asked among them.
    Every combination of `by` in the ranking, usually a scheme each, answers for every judged query."""
    top = max([*ks, recall])
    best = ideal(qrels, ks)
    if asked is not None:
        best = best.join(asked.select("query_id").distinct(), "query_id", "left_semi")
    hits = ranking.filter(F.col("rank") <= top).select(*by, "query_id", "doc_id", "rank").join(qrels.withColumnRenamed("corpus_id", "doc_id"), ["query_id", "doc_id"])
    got = hits.groupBy(*by, "query_id").agg(*(F.sum(F.when(F.col("rank") <= k, _gain("rank"))).alias(f"dcg{k}") for k in ks), F.sum((F.col("rank") <= recall).cast("int")).alias("found"))
    if by:
        best = best.crossJoin(ranking.select(*by).distinct())  # as many as there are schemes
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return best.join(got, [*by, "query_id"], "left").select(*by, "query_id", *((z(f"dcg{k}") / F.col(f"idcg{k}")).alias(f"ndcg{k}") for k in ks), (z("found") / F.col("relevant")).alias(f"recall{recall}"))


def means(quality: DataFrame, by: Sequence[str] = ("scheme",)) -> DataFrame:
    """Every metric's mean over the queries, 0 where there are none, and n_queries."""
    names = [c for c in quality.columns if c not in (*by, "query_id")]
    return quality.groupBy(*by).agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in names), F.count(F.lit(1)).alias("n_queries"))


def single_truth(ranking: DataFrame, truth: DataFrame, k: int, missing_rank: int, by: Sequence[str] = ("scheme",)) -> DataFrame:
    """(by..., r_at_1, r_at_k, mean_rank) where each query of truth (query_id, doc_id) has one right document.

    A right document outside the ranking counts with `missing_rank` (the size of the collection)."""
    groups = ranking.select(*by).distinct()
    right = truth.crossJoin(F.broadcast(groups)).join(ranking.select(*by, "query_id", "doc_id", "rank"), [*by, "query_id", "doc_id"], "left")
    at = F.coalesce("rank", F.lit(missing_rank))
    return right.groupBy(*by).agg(F.avg((at == 1).cast("double")).alias("r_at_1"), F.avg((at <= k).cast("double")).alias("r_at_k"), F.avg(at).alias("mean_rank"))
