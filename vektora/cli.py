"""Command lines: python -m vektora COMMAND --help.

    evaluate   statistics and running top-k of all schemes over the chunks of one dataset
    compare    the same in one pass over capped tables, with reports by group of schemes
    mini       evaluate over several datasets, with means over them
    subsets    sampled queries, their relevant documents and distractors of several datasets
    embed      vectors of corpus and queries by a service or the stand-in model

Every command works on folders that the session's executors can read; on a cluster, submit it with
spark-submit, which brings the session.
"""

from __future__ import annotations

import argparse
import logging
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vektora.operators import calibration, metrics, report, sampling, schemes
from vektora.operators.scoring import topk_schemes
from vektora.session import get_session, materialize
from vektora.sources import clients, readers, sinks
from vektora.streaming import incremental

log = logging.getLogger("vektora")


def run_log(folder: str | None) -> None:
    """Log to the console and, with a folder, to a file named by the time."""
    for old in log.handlers[:]:
        log.removeHandler(old)
        old.close()
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if folder:
        os.makedirs(folder, exist_ok=True)
        handlers.append(logging.FileHandler(os.path.join(folder, time.strftime("run_%Y%m%d_%H%M%S.log"))))
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(h)
    log.setLevel(logging.INFO)


def numbered(chunks: DataFrame) -> DataFrame:
    """Chunks with a number per row, by which ties are decided, in the order of chunks and rows."""
    number = F.regexp_extract("chunk", r"(\d+)", 1).cast("bigint") * F.lit(1 << 32) + F.col("pos")
    return chunks.select(number.alias("n"), F.col("id").alias("name"), "v")


def judged(spark: SparkSession, data: str, queries: DataFrame, most: int = 0) -> tuple[DataFrame, DataFrame]:
    """Judgements, and the numbered queries (n, name, v) that have some."""
    qrels = readers.judgements(spark, readers.judgements_file(spark, f"{data}/qrels"))
    asked = queries.join(qrels.select(F.col("query_id").alias("name")).distinct(), "name", "left_semi")
    return qrels, asked.orderBy("n").limit(most) if most else asked


def pick(every: list[schemes.Scheme], names: list[str] | None) -> list[schemes.Scheme]:
    if not names:
        return schemes.distinct(every)[0]
    found, missing = schemes.select(every, names)
    for m in missing:
        log.warning("no such scheme: %s", m)
    if not found:
        raise SystemExit("none of the schemes is known; see --list-schemes")
    return found


def scored(ranking: DataFrame, qrels: DataFrame, asked: DataFrame, docs: DataFrame, chosen: list[schemes.Scheme], baseline: str = "float32") -> DataFrame:
    """One row per scheme: bits, metrics, number of queries, ratio and share retained."""
    spark = ranking.sparkSession
    named = ranking.join(asked.select(F.col("n").alias("query_id"), F.col("name").alias("q")), "query_id").join(docs.select(F.col("n").alias("doc_id"), F.col("name").alias("d")), "doc_id")
    named = named.select("scheme", F.col("q").alias("query_id"), F.col("d").alias("doc_id"), "rank")
    m = metrics.means(metrics.per_query(named, qrels, asked=asked.select(F.col("name").alias("query_id"))))
    bits = spark.createDataFrame([(s.name, s.bits_per_vec) for s in chosen], "scheme string, bits_per_vec int")
    return report.with_baseline(m.join(F.broadcast(bits), "scheme"), baseline, "ndcg10")


def evaluate_one(spark: SparkSession, embed: str, data: str, out: str, tag: str = "", super_batch: int = 50_000, k: int = 100, names: list[str] | None = None) -> DataFrame:
    """Results of one dataset, written to `out`; the state below out/progress lets a broken run go on."""
    queries = materialize(numbered(readers.legacy_chunks(spark, f"{embed}/queries", tag)), "queries").df
    qrels, asked = judged(spark, data, queries)
    sizes = readers.legacy_sizes(spark, f"{embed}/corpus", tag)
    if not sizes:
        raise SystemExit(f"no chunks of tag '{tag}' in {embed}/corpus")
    dim = len(queries.select("v").first()["v"])
    batches = readers.super_batches(sizes, super_batch)
    read = lambda paths: numbered(readers.legacy_chunks(spark, "", files=list(paths))).withColumnRenamed("n", "id")
    log.info("%d chunks, %d rows, %d super-batches, %d numbers", len(sizes), sum(n for _, n in sizes), len(batches), dim)
    first = incremental.State(spark, f"{out}/progress/statistics", {"dim": dim, "batches": [len(b) for b in batches]})
    incremental.run_super_batches(batches, read, incremental.statistics_step(first, dim), first)
    stats = calibration.collect(incremental.finished_statistics(first, rank=True))
    chosen = pick(schemes.registry(dim, stats), names)
    second = incremental.State(spark, f"{out}/progress/scores", {"k": k, "schemes": [s.name for s in chosen], "batches": [len(b) for b in batches]})
    q = asked.select(F.col("n").alias("id"), "v")
    incremental.run_super_batches(batches, read, incremental.schemes_step(second, q, k, dim, chosen, stats), second)
    docs = numbered(readers.legacy_chunks(spark, f"{embed}/corpus", tag)).select("n", "name")
    r = materialize(scored(second.read(), qrels, asked, docs, chosen), "results").df
    sinks.write_results(r, out, readers.metric_columns(r))
    return r


def evaluate(a, spark) -> None:
    if a.list_schemes:
        for s in schemes.registry(a.dim):
            print(f"{s.name:<40} {s.bits_per_vec:>8}")
        return
    evaluate_one(spark, a.embed_dir, a.data_dir, a.output_dir, a.embed_tag, a.super_batch, a.k, a.schemes).orderBy(F.desc("bits_per_vec"), "scheme").show(100, False)


def compare(a, spark) -> None:
    """All schemes over tables that are capped on request."""
    docs = materialize(numbered(readers.capped(readers.legacy_chunks(spark, f"{a.embed_dir}/corpus", a.embed_tag), a.max_corpus)), "docs").df
    queries = materialize(numbered(readers.legacy_chunks(spark, f"{a.embed_dir}/queries", a.embed_tag)), "queries").df
    qrels, asked = judged(spark, a.data_dir, queries, a.max_queries)
    # only queries with a relevant document among those loaded
    there = qrels.join(docs.select(F.col("name").alias("corpus_id")), "corpus_id", "left_semi").select(F.col("query_id").alias("name")).distinct()
    asked = materialize(asked.join(there, "name", "left_semi"), "asked").df
    dim = len(queries.select("v").first()["v"])
    stats = calibration.collect(calibration.angle_statistics(docs, "v", dim))
    clips = tuple(range(0, 101, 10)) if a.fine_sweep else schemes.CLIPS
    chosen = schemes.distinct(schemes.registry(dim, stats, clips=clips))[0]
    top = topk_schemes(docs, "n", "v", dim, chosen, stats, asked.select(F.col("n").alias("id"), "v"), a.k)
    r = materialize(scored(materialize(top, "top").df, qrels, asked, docs, chosen), "results").df
    sinks.write_results(r, a.output_dir, readers.metric_columns(r))
    pos, jac = (r.filter(F.col("scheme").rlike(f"^{p}_clip_\\d+pct$")) for p in ("pos", "jac"))
    report.tradeoff(pos, jac, "ndcg10", dim, a.full_corpus_n).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{a.output_dir}/tradeoff")
    report.pareto(r.select("scheme", "bits_per_vec", "ndcg10"), "ndcg10").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{a.output_dir}/pareto")


def mini(a, spark) -> None:
    """Every dataset that has records and vectors, then means over datasets."""
    found, missing = readers.common_subsets(spark, a.data_root, a.embed_root, a.subsets)
    for m in missing:
        log.warning("no such subset: %s", m)
    if not found:
        raise SystemExit("no subsets to evaluate")
    every = None
    for name in found:
        r = evaluate_one(spark, f"{a.embed_root}/{name}", f"{a.data_root}/{name}", f"{a.output_root}/{name}", a.embed_tag, a.super_batch, a.k).withColumn("subset", F.lit(name))
        every = r if every is None else every.unionByName(r)
    names = readers.metric_columns(every)
    one = lambda df, at: df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{a.output_root}/{at}")
    one(every, "by_subset")
    one(every.filter("scheme = 'float32'").select("subset", *names), "baselines")
    one(report.macro(every, names).orderBy(F.desc("bits_per_vec"), "scheme"), "by_scheme")


def subsets(a, spark) -> None:
    out = None
    for name in a.subsets:
        if not {"corpus.jsonl", "queries.jsonl"} <= set(readers.listing(spark, f"{a.src_root}/{name}")):
            log.warning("no such subset: %s", name)
            continue
        at = f"{a.src_root}/{name}"
        tag = F.lit(name).alias("dataset")
        corpus = readers.jsonl_records(spark, f"{at}/corpus.jsonl").select(tag, F.col("id").alias("_id"), "title", "text")
        queries = readers.jsonl_queries(spark, f"{at}/queries.jsonl").select(tag, F.col("id").alias("_id"), "text")
        qrels = readers.judgements(spark, readers.judgements_file(spark, f"{at}/qrels")).select(tag, "query_id", "corpus_id", "score")
        new = (corpus, queries, qrels)
        out = new if out is None else tuple(x.unionByName(y) for x, y in zip(out, new, strict=True))
    if out is None:
        raise SystemExit("none of the subsets exists")
    parts = sampling.subsets(*out, a.n_queries, a.n_distractors, a.seed)
    sinks.write_subset(parts, out[0], out[1], sampling.build_info(parts, a.n_queries, a.seed), a.dst_root)


def embed(a, spark) -> None:
    key = os.environ.get(a.key_variable, "")
    make = {
        "hosted": lambda: clients.embedder(clients.hosted(a.url, a.model, key)),
        "raw": lambda: clients.embedder(clients.raw(a.url, a.model, key)),
        "local": lambda: clients.embedder(clients.local(a.url, a.model), a.ready),
        "stand-in": lambda: readers.hashing_embedder(a.dim),
    }[a.source]()
    for at in readers.discover_datasets(spark, a.data_dir):
        name = at.rstrip("/").rsplit("/", 1)[1]
        if a.datasets and name not in a.datasets:
            continue
        for split, skip in (("corpus", a.skip_corpus), ("queries", a.skip_queries)):
            if skip:
                continue
            items = readers.jsonl_records(spark, f"{at}/corpus.jsonl", a.trim).select("id", F.col("content").alias("text")) if split == "corpus" else readers.jsonl_queries(spark, f"{at}/queries.jsonl")
            to = f"{a.output_dir}/{name}/{split}"
            done = spark.read.parquet(to).select("id") if readers.listing(spark, to) else None
            cut = readers.truncated(F.col("text"), a.max_tokens)
            v = readers.embed(items.select("id", cut.alias("text")), "id", "text", make, a.dim, a.batch_size, done, halve=False)
            sinks.write_vectors(v, to, resume=False)
            log.info("%s %s done", name, split)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vektora")
    p.add_argument("--cores", default="*")
    p.add_argument("--log-dir")
    sub = p.add_subparsers(dest="command", required=True)

    def command(f, *flags):
        c = sub.add_parser(f.__name__)
        c.set_defaults(run=f)
        for name, more in flags:
            c.add_argument(f"--{name}", **more)

    text, need, many = (lambda d="": {"default": d}), {"required": True}, {"nargs": "*", "default": None}
    number = lambda d: {"type": int, "default": d}
    flag = {"action": "store_true"}
    command(
        evaluate, ("embed-dir", text()), ("data-dir", text()), ("embed-tag", text()), ("output-dir", text("results")), ("super-batch", number(50_000)),
        ("k", number(100)), ("schemes", many), ("list-schemes", flag), ("dim", number(1536)),
    )
    command(
        compare, ("embed-dir", need), ("data-dir", need), ("embed-tag", text()), ("output-dir", text("results")), ("max-corpus", number(50_000)), ("max-queries", number(0)),
        ("k", number(100)), ("fine-sweep", flag), ("full-corpus-n", number(report.FULL_SIZE)),
    )
    command(mini, ("embed-root", need), ("data-root", need), ("output-root", text("results")), ("subsets", many), ("embed-tag", text()), ("super-batch", number(50_000)), ("k", number(100)))
    command(subsets, ("src-root", need), ("dst-root", need), ("subsets", {"nargs": "+", "required": True}), ("n-queries", number(sampling.N_QUERIES)), ("n-distractors", number(sampling.N_DISTRACTORS)), ("seed", number(sampling.SEED)))
    command(
        embed, ("data-dir", need), ("output-dir", text("embeddings")), ("datasets", many), ("source", {"choices": ("hosted", "raw", "local", "stand-in"), "default": "stand-in"}),
        ("url", text()), ("model", text("stand-in")), ("key-variable", text("EMBEDDING_KEY")), ("ready", {"type": float, "default": 120.0}), ("dim", number(64)), ("batch-size", number(256)),
        ("max-tokens", number(8000)), ("trim", flag), ("skip-corpus", flag), ("skip-queries", flag),
    )
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    run_log(a.log_dir)
    a.run(a, spark or SparkSession.getActiveSession() or get_session(a.cores))
