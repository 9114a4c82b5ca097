"""Judgement lines that name passages or queries which were not there when the line was judged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vektora.operators.referential import orphans

#: reference column -> table that it points into
FIELDS = {"corpus_id": "corpus", "query_id": "queries"}

#: A line without a reference is no case; one without a dataset can't be found.
MATCH = {"dataset": "unmatched", "ref": "holds"}


def lines(spark: SparkSession, sf: str, field: str) -> DataFrame:
    """Distinct lines with the trimmed reference, null for null and empty ones, and the line's time."""
    q = spark.read.parquet(f"{sf}/qrels.parquet")
    ref = F.expr(f"trim(BOTH ' \t' FROM {field})")
    return q.select("qrel_id", "dataset", F.when(ref != "", ref).alias("ref"), F.coalesce("judged_at", "loaded_at").alias("t")).distinct()


def failing(spark: SparkSession, sf: str) -> DataFrame:
    """(qrel_id, dataset, ref, t, ref_field) of every failing reference; a null dataset has no records."""
    out = None
    for field, table in FIELDS.items():
        c = lines(spark, sf, field)
        p = spark.read.parquet(f"{sf}/{table}.parquet").select("dataset", "_id", "ingested_at", "deleted_at")
        bad = orphans(c, p, {"dataset": "dataset", "ref": "_id"}, MATCH, "t", "ingested_at", "deleted_at", salt_by=("qrel_id",)).withColumn("ref_field", F.lit(field))
        out = bad if out is None else out.unionByName(bad)
    return out


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return failing(spark, sf).select("qrel_id", "ref_field", F.date_format("t", "yyyy-MM").alias("period")).distinct()


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    """Failing lines per referenced table, dataset and month."""
    table = F.element_at(F.create_map(*(F.lit(x) for kv in FIELDS.items() for x in kv)), F.col("ref_field"))
    bad = failing(spark, sf).select("qrel_id", table.alias("referenced_table"), "dataset", F.date_format("t", "yyyy-MM").alias("period")).distinct()
    return bad.groupBy("referenced_table", "dataset", "period").agg(F.count(F.lit(1)).alias("lines"))


def _sql(field: str, table: str) -> str:
    return f"""SELECT DISTINCT qrel_id, '{field}' AS ref_field, '{table}' AS referenced_table, dataset, strftime(t, '%Y-%m') AS period
FROM (SELECT qrel_id, dataset, trim({field}, ' ' || chr(9)) AS ref, coalesce(judged_at, loaded_at) AS t FROM qrels) q
WHERE ref <> '' AND NOT EXISTS (SELECT 1 FROM {table} r WHERE r.dataset = q.dataset AND r._id = q.ref
  AND r.ingested_at <= q.t AND (r.deleted_at IS NULL OR r.deleted_at > q.t))"""


ALL_SQL = "\nUNION ALL\n".join(_sql(f, t) for f, t in FIELDS.items())

QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
ORACLES = {
    "p1_found": f"SELECT DISTINCT qrel_id, ref_field, period FROM ({ALL_SQL})",
    "p1_report": f"SELECT referenced_table, dataset, period, count(DISTINCT qrel_id) AS lines FROM ({ALL_SQL}) GROUP BY ALL",
}
