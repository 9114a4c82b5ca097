"""Passages over 2,000 characters, cut into overlapping pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vektora.llm.chunking import split_oversized
from vektora.session import dealt

LIMIT, OVERLAP = 2000, 200


def composed(spark: SparkSession, sf: str) -> DataFrame:
    """One row per _id with a text over the limit: title, line feed, text, or the one that isn't empty; of differing versions the smallest."""
    c = spark.read.parquet(f"{sf}/corpus.parquet")
    both = F.concat_ws("\n", F.expr("nullif(title, '')"), F.expr("nullif(text, '')"))
    long = c.select("_id", both.alias("composed")).filter((F.length("composed") > LIMIT) & F.col("_id").isNotNull())
    return dealt(long, "_id").groupBy("_id").agg(F.min("composed").alias("composed"))


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_oversized(composed(spark, sf), "_id", "composed", LIMIT, OVERLAP).withColumnRenamed("_id", "corpus_id")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """The records that were cut, by their first pieces."""
    return p4_pieces(spark, sf).filter("seq = 0").select("corpus_id", "unbroken_from")


def p4_rejoined(spark: SparkSession, sf: str) -> DataFrame:
    """(corpus_id, text, oversized, torn): every cut record put together again from its pieces, with the number of pieces
    over the limit and of those that don't begin with the last OVERLAP characters of the one before."""
    w = Window.partitionBy("corpus_id").orderBy("seq")
    p = p4_pieces(spark, sf).withColumn("before", F.lag("piece").over(w))
    shared = F.least(F.lit(OVERLAP), F.coalesce(F.length("before"), F.lit(0)))
    torn = F.expr("right(before, n)") != F.expr("left(piece, n)")
    p = p.withColumn("n", shared).withColumn("fresh", F.expr("substring(piece, n + 1)"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "fresh"))), lambda x: x["fresh"]), "")
    return p.groupBy("corpus_id").agg(whole.alias("text"), F.sum((F.length("piece") > LIMIT).cast("int")).alias("oversized"), F.sum(F.coalesce(torn, F.lit(False)).cast("int")).alias("torn"))


QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces, "p4_rejoined": p4_rejoined}
ORACLES = {
    "p4_found": r"""
WITH c AS (SELECT DISTINCT _id, CASE WHEN coalesce(title, '') <> '' AND coalesce(text, '') <> '' THEN title || chr(10) || text
  ELSE coalesce(title, '') || coalesce(text, '') END AS t FROM corpus)
SELECT _id AS corpus_id, CAST(CASE WHEN list_max(list_transform(string_split_regex(t, '[ \t\r\n]'), lambda x: length(x))) > 2000
  THEN 1 + list_sum(list_transform(list_filter(list_zip(range(1, 1 + len(string_split_regex(t, '[ \t\r\n]'))), string_split_regex(t, '[ \t\r\n]')),
    lambda p: p[1] < list_position(list_transform(string_split_regex(t, '[ \t\r\n]'), lambda x: length(x) > 2000), true)), lambda p: length(p[2]) + 1))
  ELSE 0 END AS INTEGER) AS unbroken_from
FROM c WHERE length(t) > 2000""",
    "p4_rejoined": """
WITH c AS (SELECT DISTINCT _id, CASE WHEN coalesce(title, '') <> '' AND coalesce(text, '') <> '' THEN title || chr(10) || text
  ELSE coalesce(title, '') || coalesce(text, '') END AS t FROM corpus)
SELECT _id AS corpus_id, t AS text, 0 AS oversized, 0 AS torn FROM c WHERE length(t) > 2000""",
}
