"""About a tenth of the queries and of the passages, stable while rows are added."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vektora.llm.stable_sample import DIGITS, Register
from vektora.session import scratch

SHARE, SEED = 0.1, "vektora"


def idents(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for table in ("corpus", "queries"):
        t = spark.read.parquet(f"{sf}/{table}.parquet").select(F.lit(table).alias("kind"), F.col("_id").alias("id"), "ingested_at")
        out = t if out is None else out.unionByName(t)
    return out


def p6_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The sample after two loads: rows of the first half of the time covered, then all rows.

    Each load opens the register anew, as runs on different days do. It stays where the session's setting
    `spark.vektora.register` says; without, it is deleted when the driver ends."""
    rows, path = idents(spark, sf), spark.conf.get("spark.vektora.register", None) or scratch(spark, "register")
    span = rows.agg(F.min("ingested_at").cast("timestamp").cast("double").alias("a"), F.max("ingested_at").cast("timestamp").cast("double").alias("b")).first()
    middle = ((span["a"] or 0.0) + (span["b"] or 0.0)) / 2
    Register(spark, path, SEED).insert(rows.filter(F.col("ingested_at").cast("timestamp").cast("double") <= middle), 0)
    Register(spark, path, SEED).insert(rows, 1)
    return Register(spark, path, SEED).select(SHARE)


QUERIES = {"p6_sample": p6_sample}
ORACLES = {
    "p6_sample": f"""
SELECT kind, id, u FROM (SELECT kind, id, CAST('0x' || substr(md5('{SEED}|' || kind || '|' || id), 1, {DIGITS}) AS BIGINT) / CAST(16 AS DOUBLE) ** {DIGITS} AS u
  FROM (SELECT 'corpus' AS kind, _id AS id FROM corpus UNION SELECT 'queries', _id FROM queries) WHERE id IS NOT NULL) WHERE u < {SHARE}""",
}
