"""All documents as ids of a public tokenizer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vektora.llm.encoding import decode, encode, encode_with_offsets, truncate
from vektora.session import spread

#: Fixed value: the usual limit.
MOST_TOKENS = 8000


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode(documents(spark, sf), "doc_id", "text")


def p7_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return encode_with_offsets(documents(spark, sf), "doc_id", "text")


def p7_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's text, decoded from its ids."""
    return decode(p7_ids(spark, sf), "doc_id")


def p7_truncated(spark: SparkSession, sf: str) -> DataFrame:
    """What an embedder that takes MOST_TOKENS gets of every document."""
    return truncate(documents(spark, sf), "doc_id", "text", MOST_TOKENS)


def p7_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, first, upto, gaps): where the ids' offsets begin and end, and how many code points none of them covers."""
    o = p7_offsets(spark, sf)
    gaps = F.aggregate(F.zip_with("starts", F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0)))), lambda a, b: F.greatest(a - b, F.lit(0))), F.lit(0), lambda s, x: s + x)
    return o.select("doc_id", F.coalesce(F.array_min("starts"), F.lit(0)).alias("first"), F.coalesce(F.array_max("ends"), F.lit(0)).alias("upto"), F.when(F.size("ids") > 0, gaps).otherwise(F.lit(0)).alias("gaps"))


QUERIES = {"p7_truncated": p7_truncated, "p7_coverage": p7_coverage, "p7_ids": p7_ids, "p7_offsets": p7_offsets, "p7_round_trip": p7_round_trip}
ORACLES = {
    "p7_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p7_coverage": "SELECT doc_id, 0 AS first, CAST(coalesce(length(text), 0) AS INTEGER) AS upto, 0 AS gaps FROM documents",
}
