"""The registered queries and their operators do the whole job."""

import datetime as dt

import numpy as np

from vektora.operators import referential, schemes, scoring
from vektora.plans import p1_references, record_queries, retrieval_queries, vector_queries


def test_true_ranks_beyond_the_ranking(spark, tmp_path):
    row = [0.1 * (i % 7 - 3) for i in range(64)]
    rows = spark.createDataFrame([(i, 0, row) for i in range(200)], "vec_id bigint, label int, embedding array<float>")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = retrieval_queries.QUERIES["single_truth"](spark, str(tmp_path)).collect()
    # equal rows go by id: the truths 0, 50, 100 and 150 are at 1, 51, 101 and 151
    assert sorted(map(tuple, got)) == [(s, 0.25, 0.25, 76.0) for s in ("angle_int2_uniform", "cart_int4")]


def test_true_ranks_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK", 3)
    rng = np.random.default_rng(5)
    m, q, right = rng.normal(size=(60, 4)), rng.normal(size=(8, 4)), rng.integers(0, 60, 8)
    docs = spark.createDataFrame([("f", i, v.tolist()) for i, v in enumerate(m)] + [("f", 99, None)], "scheme string, id bigint, v array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "id bigint, v array<double>")
    truth = spark.createDataFrame([(i, int(t)) for i, t in enumerate(right)] + [(0, 1000)], "query_id bigint, doc_id bigint")
    got = {(r.query_id, r.doc_id): r["rank"] for r in scoring.truth_ranks(docs, queries, truth).collect()}
    assert got == {(i, t): int((np.round(q[i] @ m.T, 9) > round(q[i] @ m[t], 9)).sum()) + 1 for i, t in enumerate(right)}


def test_subsets_of_the_usual_size(spark, tmp_path):
    n = 40
    spark.createDataFrame([("d", f"c{i}") for i in range(n)], "dataset string, _id string").write.parquet(f"{tmp_path}/corpus.parquet")
    spark.createDataFrame([("d", f"q{i}") for i in range(9)], "dataset string, _id string").write.parquet(f"{tmp_path}/queries.parquet")
    spark.createDataFrame([("d", f"q{i}", f"c{i}", 1) for i in range(9)], "dataset string, query_id string, corpus_id string, score int").write.parquet(f"{tmp_path}/qrels.parquet")
    run = lambda name: record_queries.QUERIES[name](spark, str(tmp_path))
    assert run("sample_queries_hash").count() == run("subset_qrels").count() == 9 and run("subset_corpus").count() == n
    assert tuple(run("subset_build_info").first()) == tuple(run("build_info_json").first()) == ("d", 1000, 9, n, 9, n - 9, 9, 42)


def test_columns_take_queries_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([("f", i, [1.0, float(i)]) for i in range(4)], "scheme string, id bigint, v array<double>")
    queries = spark.createDataFrame([(i, [1.0, i - 2.0]) for i in range(5)], "id bigint, v array<double>")
    monkeypatch.setattr(scoring, "BLOCK", 2)
    rows = lambda f: sorted((r.query_id, r.doc_id, r["rank"]) for r in f(docs, queries, 3).collect())
    assert len(rows(scoring.topk_columns)) == 15 and rows(scoring.topk_columns) == rows(scoring.topk)


def test_normalised_vectors_of_both_splits(spark, tmp_path):
    at = lambda split: ("d", split, "chunk_0", 0)
    keys = "dataset string, split string, chunk string, pos int"
    spark.createDataFrame([(*at(s), [2.0] * 64) for s in ("corpus", "queries")], f"{keys}, vecs array<float>").write.parquet(f"{tmp_path}/chunk_vecs.parquet")
    spark.createDataFrame([(*at(s), s[0]) for s in ("corpus", "queries")], f"{keys}, ids string").write.parquet(f"{tmp_path}/chunk_ids.parquet")
    got = record_queries.QUERIES["normalised_vectors"](spark, str(tmp_path)).collect()
    assert sorted((r.split, r.id) for r in got) == [("corpus", "c"), ("queries", "q")] and all(r.v == [0.125] * 64 for r in got)


def test_texts_are_cut_at_the_limit_of_the_reference(spark, tmp_path):
    rows = [("long", "t", "x" * 40_000), ("short", None, "y" * 600), ("none", None, None)]
    spark.createDataFrame(rows, "_id string, title string, text string").write.parquet(f"{tmp_path}/corpus.parquet")
    got = dict(map(tuple, record_queries.QUERIES["truncate_text"](spark, str(tmp_path)).collect()))
    assert got == {"long": "t\n" + "x" * 31_998, "short": "y" * 600, "none": " "}


def test_passages_and_queries_are_embedded(spark, tmp_path):
    spark.createDataFrame([("d", "a", "big", "cat"), ("d", "a", "big", "cat"), ("e", "b", None, None)], "dataset string, _id string, title string, text string").write.parquet(f"{tmp_path}/corpus.parquet")
    spark.createDataFrame([("d", "a", "cat"), ("d", "q", "big\ncat")], "dataset string, _id string, text string").write.parquet(f"{tmp_path}/queries.parquet")
    got = {(r.dataset, r.split, r._id): r.v for r in record_queries.QUERIES["embedded_queries"](spark, str(tmp_path)).collect()}
    assert set(got) == {("d", "corpus", "a"), ("e", "corpus", "b"), ("d", "queries", "a"), ("d", "queries", "q")}
    assert got["d", "corpus", "a"] == got["d", "queries", "q"] != got["d", "queries", "a"] and all(len(v) == 64 for v in got.values())


def test_every_budget_and_every_clip(spark, sf):
    tiers = vector_queries.QUERIES["greedy_tiers"](spark, sf).groupBy("scheme").sum("bits").collect()
    assert {r.scheme for r in tiers} == {f"greedy_{b}b" for b in vector_queries.SMALL_BUDGETS}
    assert all(0 < r["sum(bits)"] <= int(r.scheme[7:-1]) for r in tiers)
    clips = retrieval_queries.QUERIES["tradeoff_table"](spark, sf).collect()
    assert sorted(r.clip_pct for r in clips) == sorted(schemes.CLIPS)


def test_null_datasets_go_through_the_masks(spark, tmp_path, monkeypatch):
    record = "dataset string, _id string, ingested_at timestamp_ntz, deleted_at timestamp_ntz"
    day = dt.datetime(2024, 5, 1)
    for name in ("corpus", "queries"):
        spark.createDataFrame([("d", "a", day, None)], record).write.parquet(f"{tmp_path}/{name}.parquet")
    lines = [(1, "d", "a", "a"), (2, "d", "b", None), (3, None, "a", " "), (4, None, None, None)]
    spark.createDataFrame([(*x, day, day) for x in lines], "qrel_id bigint, dataset string, corpus_id string, query_id string, judged_at timestamp_ntz, loaded_at timestamp_ntz").write.parquet(f"{tmp_path}/qrels.parquet")
    seen = []
    monkeypatch.setattr(p1_references, "orphans", lambda *a, **k: seen.append((a[3], a[0].filter("dataset is null").count())) or referential.orphans(*a, **k))
    got = p1_references.p1_found(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(2, "corpus_id", "2024-05"), (3, "corpus_id", "2024-05")]
    assert seen == [(p1_references.MATCH, 2), (p1_references.MATCH, 2)]
