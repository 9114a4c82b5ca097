"""Files in, files out."""

import json

import numpy as np
import pytest

from vektora.operators import sampling
from vektora.sources import readers, sinks


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "data" / "nq"
    (d / "qrels").mkdir(parents=True)
    lines = [{"_id": 1, "title": "T", "text": "x"}, {"_id": "b", "text": "only"}, {"_id": "c", "title": " t ", "text": None}, {"_id": "d", "extra": {"_id": 1}}]
    (d / "corpus.jsonl").write_text("\n\n".join(map(json.dumps, lines)) + "\n")
    (d / "queries.jsonl").write_text('{"_id": "q", "text": null}\n')
    (d / "qrels" / "dev.tsv").write_text("query-id\tcorpus-id\tscore\nq\t1\t1\nq\t1\t2\nq\tb\t0\n")
    (d / "qrels" / "train.tsv").write_text("query-id\tcorpus-id\tscore\nq\tb\t1\n")
    return tmp_path


def test_jsonl(spark, folder):
    path = f"{folder}/data/nq/corpus.jsonl"
    assert {r.id: r.content for r in readers.jsonl_records(spark, path).collect()} == {"1": "T\nx", "b": "only", "c": " t ", "d": ""}
    assert {r.id: r.content for r in readers.jsonl_records(spark, path, trimmed=True).collect()} == {"1": "T\nx", "b": "only", "c": "t", "d": "[empty]"}
    assert readers.count_lines(spark, path) == 7
    assert [tuple(r) for r in readers.jsonl_queries(spark, f"{folder}/data/nq/queries.jsonl").collect()] == [("q", "")]


def test_judgements(spark, folder):
    path = readers.judgements_file(spark, f"{folder}/data/nq/qrels")
    assert path.endswith("dev.tsv")
    assert [tuple(r) for r in readers.judgements(spark, path).collect()] == [("q", "1", 2)]
    with pytest.raises(FileNotFoundError):
        readers.judgements_file(spark, f"{folder}/data")


def test_discovery(spark, folder):
    assert readers.discover_datasets(spark, f"{folder}/data") == [f"{folder}/data/nq"]
    v = folder / "vec" / "nq" / "corpus"
    v.mkdir(parents=True)
    for n in ("chunk_0000000.npy", "chunk_0000001.npy", "chunk_0000000.tag.npy", "other.npy"):
        (v / n).touch()
    assert [p.rsplit("/", 1)[1] for p in readers.discover_chunks(spark, str(v))] == ["chunk_0000000.npy", "chunk_0000001.npy"]
    assert [p.rsplit("/", 1)[1] for p in readers.discover_chunks(spark, str(v), "tag")] == ["chunk_0000000.tag.npy"]
    assert readers.common_subsets(spark, f"{folder}/data", f"{folder}/vec", ["nq", "no"]) == (["nq"], ["no"])


def test_legacy_chunks(spark, tmp_path):
    m = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "chunk_0000000.npy", m)
    (tmp_path / "chunk_0000000.ids.txt").write_text("a\nb\nc\nd\n")
    got = readers.legacy_chunks(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.id, r.v) for r in got] == list(zip("abcd", m.tolist()))
    (tmp_path / "chunk_0000000.ids.txt").write_text("a\n")
    with pytest.raises(Exception, match="4 vectors but 1 ids"):
        readers.legacy_chunks(spark, str(tmp_path)).collect()
    assert readers.legacy_chunks(spark, str(tmp_path / "none")).count() == 0


def test_embed_halves_and_resumes(spark):
    def make():
        def model(texts):
            if len(texts) > 2:
                raise RuntimeError("too many")
            return [[float(len(t)), 1.0] for t in texts]

        return model

    items = spark.createDataFrame([(i, "x" * i) for i in range(7)] + [(7, None)], "k int, text string")
    got = readers.embed(items, "k", "text", make, 2, already=spark.createDataFrame([("3",)], "id string"))
    rows = {r.id: r.v for r in got.collect()}
    assert sorted(rows) == ["0", "1", "2", "4", "5", "6", "7"] and rows["7"] == [0.0, 1.0]
    assert np.linalg.norm(rows["6"]) == pytest.approx(1)


def test_sinks(spark, tmp_path):
    v = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "id string, v array<float>")
    sinks.write_vectors(v, f"{tmp_path}/v")
    sinks.write_vectors(v.unionByName(spark.createDataFrame([("c", [3.0])], "id string, v array<float>")), f"{tmp_path}/v")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/v").collect()) == ["a", "b", "c"] and sinks.done(v, f"{tmp_path}/v")
    res = spark.createDataFrame([("s", 8, 0.5), ("t", 16, 0.75)], "scheme string, bits_per_vec int, ndcg10 double")
    sinks.write_results(res, f"{tmp_path}/r", ["ndcg10"])
    assert [r.value.split() for r in spark.read.text(f"{tmp_path}/r/txt").collect()] == [["t", "16", "0.7500"], ["s", "8", "0.5000"]]
    back = readers.results(spark, {"nq": f"{tmp_path}/r/csv"}, "scheme string, bits_per_vec int, ndcg10 double")
    assert {r.subset for r in back.collect()} == {"nq"} and back.count() == 2


def test_subsets(spark, tmp_path):
    corpus = spark.createDataFrame([("d", f"c{i}", None, "t") for i in range(30)], "dataset string, _id string, title string, text string")
    queries = spark.createDataFrame([("d", f"q{i}", "t") for i in range(6)], "dataset string, _id string, text string")
    qrels = spark.createDataFrame([("d", f"q{i}", f"c{i}", 1) for i in range(6)] + [("d", "q0", "gone", 1)], "dataset string, query_id string, corpus_id string, score int")
    parts = sampling.subsets(corpus, queries, qrels, 3, 5)
    info = sampling.build_info(parts, 3).first()
    assert (info.queries_written, info.rel_docs, info.distractors, info.corpus_written, info.qrels_rows) == (3, 3, 5, 8, 3)
    sinks.write_subset(parts, corpus, queries, sampling.build_info(parts, 3), f"{tmp_path}/s")
    assert spark.read.json(f"{tmp_path}/s/corpus").count() == 8
