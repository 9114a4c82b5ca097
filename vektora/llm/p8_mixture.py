"""Documents of several sources in the proportions of mix_targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vektora.llm.encoding import count_tokens
from vektora.llm.mixing import copies, shares
from vektora.session import materialize, spread


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/mix_targets.parquet")


def sized(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, source, n_tokens) of every document with a source."""
    d = spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text"))
    d = d.select(F.struct("doc_id", F.lower(F.trim("source")).alias("source")).alias("k"), "text").filter("k.source is not null")
    return materialize(count_tokens(d, "k", "text").select("k.doc_id", "k.source", "n_tokens"), "sized").df


def p8_copies(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of every document of a target source, in the largest mixture that has every share."""
    return copies(sized(spark, sf), "doc_id", "source", "n_tokens", _targets(spark, sf))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return shares(p8_copies(spark, sf), "source", "n_tokens", _targets(spark, sf))


def p8_large_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The shares of a mixture of as many tokens as the target sources have: small sources at their cap, the rest in proportion."""
    t, d = _targets(spark, sf), sized(spark, sf)
    total = d.join(F.broadcast(t.select("source").distinct()), "source", "left_semi").agg(F.sum("n_tokens")).first()[0] or 0
    return shares(copies(d, "doc_id", "source", "n_tokens", t, float(total)), "source", "n_tokens", t)


QUERIES = {"p8_copies": p8_copies, "p8_shares": p8_shares, "p8_large_shares": p8_large_shares}
ORACLES = {}
