"""Sinks: chunks of vectors, subsets, results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vektora.operators.report import fixed_width
from vektora.session import _fs


def done(df: DataFrame, path: str) -> bool:
    """Whether a table was written completely."""
    fs, p = _fs(df.sparkSession, f"{path}/_SUCCESS")
    return fs.exists(p)


def write_vectors(df: DataFrame, path: str, resume: bool = True) -> None:
    """Add the rows (id, v) of `df` that the table at `path` lacks; the committer makes each write whole or void."""
    spark = df.sparkSession
    fs, p = _fs(spark, path)
    if resume and fs.exists(p):
        df = df.join(spark.read.parquet(path).select("id"), "id", "left_anti")
    df.write.mode("append").parquet(path)


def write_subset(parts: dict[str, DataFrame], corpus: DataFrame, queries: DataFrame, info: DataFrame, path: str) -> None:
    """corpus and queries as JSONL, judgements as TSV with a header, sizes as JSON, each by dataset."""
    kept = parts["corpus"].select("dataset", F.col("corpus_id").alias("_id"))
    corpus.join(kept, ["dataset", "_id"], "left_semi").select("dataset", "_id", "title", "text").write.mode("overwrite").partitionBy("dataset").json(f"{path}/corpus")
    asked = parts["queries"].select("dataset", F.col("query_id").alias("_id"))
    queries.join(asked, ["dataset", "_id"], "left_semi").select("dataset", "_id", "text").write.mode("overwrite").partitionBy("dataset").json(f"{path}/queries")
    q = parts["qrels"].select("dataset", F.col("query_id").alias("query-id"), F.col("corpus_id").alias("corpus-id"), "score")
    q.write.mode("overwrite").partitionBy("dataset").option("sep", "\t").option("header", True).csv(f"{path}/qrels")
    info.write.mode("overwrite").partitionBy("dataset").json(f"{path}/info")


def write_results(results: DataFrame, path: str, metrics: list[str]) -> None:
    """A CSV file and a text table, in order of falling bits (a row per scheme)."""
    ordered = results.orderBy(F.desc("bits_per_vec"), "scheme").coalesce(1)
    ordered.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    fixed_width(ordered, metrics).write.mode("overwrite").text(f"{path}/txt")
