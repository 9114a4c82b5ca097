"""Metrics by hand, ties, short collections."""

import pytest
from pyspark.sql import functions as F

from vektora.operators import metrics, report, scoring

RANKS = "scheme string, query_id string, doc_id string, rank int"
QRELS = "query_id string, corpus_id string, score int"


def test_ndcg_by_hand(spark):
    r = spark.createDataFrame([("s", "q", "b", 1), ("s", "q", "x", 2), ("s", "q", "a", 3), ("s", "unjudged", "a", 1)], RANKS)
    q = spark.createDataFrame([("q", "a", 2), ("q", "b", 1)], QRELS)
    got = metrics.per_query(r, q, ks=(10,)).collect()
    assert len(got) == 1 and got[0].ndcg10 == pytest.approx(0.76019, abs=1e-5) and got[0].recall100 == 1.0


def test_missing_documents_count(spark):
    r = spark.createDataFrame([("s", "q", "a", 1)], RANKS)
    q = spark.createDataFrame([("q", "a", 1), ("q", "gone", 1)], QRELS)
    got = metrics.per_query(r, q, ks=(10,)).first()
    assert got.recall100 == 0.5 and got.ndcg10 < 1


def test_positive(spark):
    q = spark.createDataFrame([("q", "a", 0), ("q", "b", -1), ("q", "c", 2), ("q", "c", 1), (None, "c", 1), ("q", None, 3)], QRELS)
    assert [tuple(x) for x in metrics.positive(q).collect()] == [("q", "c", 2)]


def test_topk_ties_shortage_and_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([("f", i, [1.0, 0.0]) for i in (5, 3, 9)] + [("f", 1, None)], "scheme string, id bigint, v array<double>")
    queries = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "id bigint, v array<double>")
    monkeypatch.setattr(scoring, "BLOCK", 2)
    got = scoring.topk(docs, queries, 100).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id) for r in got] == [(q, d) for q in range(5) for d in (3, 5, 9)]
    monkeypatch.setattr(scoring, "BLOCK", 4096)
    plain = scoring.topk_columns(docs.filter("v is not null"), queries, 100)
    assert plain.count() == 15
    assert scoring.topk(docs, queries.limit(0), 5).count() == 0 and scoring.topk(docs.limit(0), queries, 5).count() == 0


def test_merge_is_idempotent(spark):
    rows = spark.createDataFrame([("f", 1, d, 1.0 / d) for d in range(1, 9)], "scheme string, query_id bigint, doc_id bigint, score double")
    once = scoring.ranked(rows, 3, ["scheme", "query_id"])
    assert sorted(map(tuple, scoring.merged(once, once, 3).collect())) == sorted(map(tuple, once.collect()))


def test_reports(spark):
    b = spark.createDataFrame([("a", 8, 0.5), ("b", 4, 0.5), ("c", 4, 0.4), ("d", 2, 0.1), ("z", 0, 0.0)], "scheme string, bits_per_vec int, m double")
    assert sorted(r.scheme for r in report.pareto(b, "m").collect()) == ["b", "d", "z"]
    got = {r.scheme: r for r in report.with_baseline(b, "a", "m").collect()}
    assert got["b"].compression_ratio == 2.0 and got["z"].compression_ratio == float("inf") and got["d"].retained == pytest.approx(0.2)
    assert [r.x for r in b.select(report.percent_of(F.lit("pos_clip_20pct")).alias("x")).limit(1).collect()] == [20]


def test_a_query_without_results_scores_0(spark):
    qrels = spark.createDataFrame([("q1", "d1", 1), ("q2", "d2", 1), ("q3", "d3", 1)], "query_id string, corpus_id string, score int")
    ranking = spark.createDataFrame([("a", "q1", "d1", 1), ("a", "q2", "d9", 1), ("b", "q2", "d2", 1)], "scheme string, query_id string, doc_id string, rank int")
    got = {(r.scheme, r.query_id): (r.ndcg5, r.recall100) for r in metrics.per_query(ranking, qrels, ks=(5,)).collect()}
    assert got == {(s, q): (1.0, 1.0) if (s, q) in (("a", "q1"), ("b", "q2")) else (0.0, 0.0) for s in "ab" for q in ("q1", "q2", "q3")}
    asked = spark.createDataFrame([("q1",), ("q2",), ("q7",)], "query_id string")
    means = {r.scheme: (round(r.ndcg5, 6), r.n_queries) for r in metrics.means(metrics.per_query(ranking, qrels, ks=(5,), asked=asked)).collect()}
    assert means == {"a": (0.5, 2), "b": (0.5, 2)}
