"""The command lines end to end over small folders."""

import json
import os

import numpy as np
import pytest

from vektora import cli
from vektora.sources import readers

DIM = 8


@pytest.fixture
def folders(tmp_path):
    rng = np.random.default_rng(4)
    for name in ("alpha", "beta"):
        data, vecs = tmp_path / "data" / name, tmp_path / "vecs" / name
        (data / "qrels").mkdir(parents=True)
        docs = rng.normal(size=(60, DIM))
        docs /= np.linalg.norm(docs, axis=1, keepdims=True)
        with open(data / "corpus.jsonl", "w") as f:
            f.writelines(json.dumps({"_id": f"d{i}", "title": f"t{i}", "text": f"body {i}"}) + "\n" for i in range(60))
        with open(data / "queries.jsonl", "w") as f:
            f.writelines(json.dumps({"_id": f"q{i}", "text": f"ask {i}"}) + "\n" for i in range(9))
        with open(data / "qrels" / "test.tsv", "w") as f:
            f.write("query-id\tcorpus-id\tscore\n" + "".join(f"q{i}\td{i}\t1\n" for i in range(8)))
        for split, m, prefix in (("corpus", docs, "d"), ("queries", docs[:9] + 0.05 * rng.normal(size=(9, DIM)), "q")):
            (vecs / split).mkdir(parents=True)
            for c, at in enumerate(range(0, len(m), 25)):
                np.save(vecs / split / f"chunk_{c:07d}.npy", m[at : at + 25].astype(np.float32))
                (vecs / split / f"chunk_{c:07d}.ids.txt").write_text("".join(f"{prefix}{i}\n" for i in range(at, min(at + 25, len(m)))))
    return tmp_path


def table(spark, path):
    return spark.read.option("header", True).option("inferSchema", True).csv(str(path))


def test_evaluate_goes_on_and_lists(spark, folders, capsys):
    args = ["evaluate", "--embed-dir", f"{folders}/vecs/alpha", "--data-dir", f"{folders}/data/alpha", "--output-dir", f"{folders}/out", "--super-batch", "30", "--schemes", "float32", "cart_int8", "no_such"]
    cli.main(args, spark)
    r = {x.scheme: x for x in table(spark, folders / "out" / "csv").collect()}
    assert set(r) == {"float32", "cart_int8"} and r["float32"].ndcg10 > 0.95 and r["float32"].n_queries == 8
    assert r["cart_int8"].compression_ratio == 4
    lines = [x.value for x in spark.read.text(f"{folders}/out/txt").collect()]
    assert len(lines) == 2 and lines[0].startswith("float32")
    before = sorted(os.listdir(folders / "out" / "progress" / "scores"))
    cli.main(args, spark)
    assert sorted(os.listdir(folders / "out" / "progress" / "scores")) == before
    with pytest.raises(ValueError, match="other settings"):
        cli.main([*args[:-1], "cart_int4"], spark)
    cli.main(["evaluate", "--list-schemes", "--dim", "64"], spark)
    assert "angle_int8_uniform" in capsys.readouterr().out


def test_compare_and_mini(spark, folders):
    cli.main(["compare", "--embed-dir", f"{folders}/vecs/alpha", "--data-dir", f"{folders}/data/alpha", "--output-dir", f"{folders}/cmp", "--max-corpus", "40", "--max-queries", "5"], spark)
    r = table(spark, folders / "cmp" / "csv")
    assert r.count() > 30 and {x.n_queries for x in r.collect()} == {5}
    assert table(spark, folders / "cmp" / "tradeoff").count() >= 4
    cli.main(["mini", "--embed-root", f"{folders}/vecs", "--data-root", f"{folders}/data", "--output-root", f"{folders}/mini", "--subsets", "alpha", "beta", "gamma"], spark)
    by = table(spark, folders / "mini" / "by_scheme")
    assert {x.n_subsets for x in by.collect()} == {2} and table(spark, folders / "mini" / "baselines").count() == 2


def test_subsets_and_embed(spark, folders):
    cli.main(["subsets", "--src-root", f"{folders}/data", "--dst-root", f"{folders}/sub", "--subsets", "alpha", "gamma", "--n-queries", "3", "--n-distractors", "5"], spark)
    assert spark.read.json(f"{folders}/sub/queries").count() == 3 and spark.read.json(f"{folders}/sub/corpus").count() == 8
    args = ["--log-dir", f"{folders}/log", "embed", "--data-dir", f"{folders}/data", "--output-dir", f"{folders}/emb", "--datasets", "beta", "--dim", "16"]
    for _ in range(2):  # the second run finds all done
        cli.main(args, spark)
    assert spark.read.parquet(f"{folders}/emb/beta/corpus").count() == 60 and spark.read.parquet(f"{folders}/emb/beta/queries").count() == 9
    assert any(x.startswith("run_") for x in os.listdir(folders / "log"))


def test_chunks(spark, folders):
    at = f"{folders}/vecs/alpha/corpus"
    sizes = readers.legacy_sizes(spark, at)
    assert [n for _, n in sizes] == [25, 25, 10]
    assert [len(b) for b in readers.super_batches(sizes, 30)] == [2, 1] and readers.super_batches([], 30) == []
    rows = readers.capped(readers.legacy_chunks(spark, at), 27).collect()
    assert sorted(r.id for r in rows) == sorted(f"d{i}" for i in range(27))
    assert readers.broken_pairs(spark, at) == []
    os.remove(f"{at}/chunk_0000000.ids.txt")
    open(f"{at}/chunk_0000002.ids.txt", "a").write("more\n")
    open(f"{at}/chunk_0000003.npy", "w").write("no numbers")
    bad = [x.rsplit("_", 1)[1] for x in readers.broken_pairs(spark, at, repair=True)]
    assert bad == ["0000000.npy", "0000002.npy", "0000003.npy"]
    assert [n for _, n in readers.legacy_sizes(spark, at)] == [25]
    assert readers.npy_shape(open(f"{at}/chunk_0000001.npy", "rb").read()) == (25, DIM)


def test_metric_columns(spark):
    df = spark.createDataFrame([("a", "0.5", 0.1, 0.2, "x", 0.3)], "scheme string, ndcg20 string, ndcg5 double, recall100 double, recall5 string, other double")
    assert readers.metric_columns(df) == ["ndcg5", "ndcg20", "recall100"]
