"""Evaluation subsets: sampled queries, all their relevant documents, and random distractors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the usual subsets.
N_QUERIES, N_DISTRACTORS, SEED = 1000, 10_000, 42


def order_key(ident: Column, seed: int = SEED) -> Column:
    """A hash by which a sample without replacement is drawn: the same in every run and layout."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), ident).cast("binary"))


def first_by_hash(df: DataFrame, by: list[str], ident: str, n: int, seed: int = SEED) -> DataFrame:
    """The n rows of each group with the smallest hashes of `ident`; groups are cut down before the shuffle."""
    w = Window.partitionBy(*by).orderBy("_h", ident)
    return df.withColumn("_h", order_key(F.col(ident), seed)).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_h", "_r")


def subsets(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, n_queries: int = N_QUERIES, n_distractors: int = N_DISTRACTORS, seed: int = SEED) -> dict[str, DataFrame]:
    """corpus, queries and qrels of the subset of every dataset.

    corpus, queries: (dataset, _id); qrels: positive (dataset, query_id, corpus_id, score). Queries are
    drawn from those with judgements; relevant documents missing from the corpus are dropped with their
    judgements; distractors are other documents of the dataset."""
    docs = corpus.select("dataset", F.col("_id").alias("corpus_id")).distinct()
    drawn = first_by_hash(qrels.select("dataset", "query_id").distinct(), ["dataset"], "query_id", n_queries, seed)
    judged = qrels.join(drawn, ["dataset", "query_id"], "left_semi").join(docs, ["dataset", "corpus_id"], "left_semi")
    relevant = judged.select("dataset", "corpus_id").distinct()
    others = first_by_hash(docs.join(relevant, ["dataset", "corpus_id"], "left_anti"), ["dataset"], "corpus_id", n_distractors, seed)
    kept = relevant.withColumn("relevant", F.lit(True)).unionByName(others.withColumn("relevant", F.lit(False)))
    present = queries.select("dataset", F.col("_id").alias("query_id")).distinct()
    return {"corpus": kept, "queries": present.join(drawn, ["dataset", "query_id"], "left_semi"), "qrels": judged}


def build_info(parts: dict[str, DataFrame], n_queries: int = N_QUERIES, seed: int = SEED) -> DataFrame:
    """One row of sizes per dataset."""
    one = lambda df, c: df.groupBy("dataset").agg(F.count(F.lit(1)).alias(c))
    kept = parts["corpus"].groupBy("dataset").agg(F.count(F.lit(1)).alias("corpus_written"), F.sum(F.col("relevant").cast("int")).alias("rel_docs"), F.sum((~F.col("relevant")).cast("int")).alias("distractors"))
    out = kept.join(one(parts["queries"], "queries_written"), "dataset", "full").join(one(parts["qrels"], "qrels_rows"), "dataset", "full")
    out = out.na.fill(0, ["corpus_written", "rel_docs", "distractors", "queries_written", "qrels_rows"])
    return out.select("dataset", F.lit(n_queries).alias("queries_requested"), "queries_written", "corpus_written", "rel_docs", "distractors", "qrels_rows", F.lit(seed).alias("seed"))
