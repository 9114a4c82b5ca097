"""Scans, joins, set operations and samples over corpus, queries, qrels and the chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vektora.functions import text
from vektora.functions.vectors import SOURCE_EPS, doubles, scaled
from vektora.operators import metrics, sampling
from vektora.sources import readers

QUERIES, ORACLES = {}, {}
#: The usual limit of tokens for a text to embed, and of rows of a table of chunks.
EMBED_TOKENS, MOST_ROWS = 8000, 50_000
CHUNK_KEYS = ["dataset", "split", "chunk", "pos"]


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def positive(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct positive (dataset, query_id, corpus_id, score), ids trimmed; the highest score of a pair counts."""
    t = lambda c: F.expr(f"trim(BOTH ' \t' FROM {c})")
    q = table(spark, sf, "qrels").filter("score > 0").select("dataset", t("query_id").alias("query_id"), t("corpus_id").alias("corpus_id"), "score")
    return q.filter("query_id <> '' and corpus_id <> ''").groupBy("dataset", "query_id", "corpus_id").agg(F.max("score").alias("score"))


_T = "trim({}, ' ' || chr(9))"
POS = f"pos AS (SELECT dataset, query_id, corpus_id, max(score) AS score FROM (SELECT dataset, {_T.format('query_id')} AS query_id, {_T.format('corpus_id')} AS corpus_id, score FROM qrels WHERE score > 0) WHERE query_id <> '' AND corpus_id <> '' GROUP BY ALL)"
_COMPOSED = "CASE WHEN coalesce(title, '') <> '' AND coalesce(text, '') <> '' THEN title || chr(10) || text ELSE coalesce(title, '') || coalesce(text, '') END"
_TRIMMED = "CASE WHEN trim(coalesce(title, '')) <> '' AND trim(coalesce(text, '')) <> '' THEN trim(title) || chr(10) || trim(text) ELSE trim(coalesce(title, '')) || trim(coalesce(text, '')) END"


@query("compose_text", f"SELECT _id, {_COMPOSED} AS content FROM corpus")
def compose_text(spark, sf):
    return table(spark, sf, "corpus").select("_id", text.composed(F.col("title"), F.col("text")).alias("content"))


@query("compose_text_trimmed", f"SELECT _id, CASE WHEN {_TRIMMED} = '' THEN '[empty]' ELSE {_TRIMMED} END AS content FROM corpus")
def compose_trimmed(spark, sf):
    return table(spark, sf, "corpus").select("_id", text.composed_trimmed(F.col("title"), F.col("text")).alias("content"))


@query("truncate_text", f"SELECT _id, CASE WHEN {_COMPOSED} = '' THEN ' ' ELSE substring({_COMPOSED}, 1, {4 * EMBED_TOKENS}) END AS content FROM corpus")
def truncate_text(spark, sf):
    """What an embedder with a limit of tokens gets."""
    return table(spark, sf, "corpus").select("_id", text.truncated(text.composed(F.col("title"), F.col("text")), EMBED_TOKENS).alias("content"))


@query("query_text", "SELECT _id, coalesce(text, '') AS text FROM queries")
def query_text(spark, sf):
    return table(spark, sf, "queries").select("_id", F.coalesce("text", F.lit("")).alias("text"))


@query("model_tags", "SELECT source, substring(string_split('models/' || source, '/')[-1], 1, 20) AS tag FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def model_tags(spark, sf):
    s = table(spark, sf, "documents").select("source").filter("source is not null").distinct()
    return s.select("source", text.short_model_name(F.concat(F.lit("models/"), F.col("source"))).alias("tag"))


@query("qrels_positive", f"WITH {POS} SELECT * FROM pos")
def qrels_positive(spark, sf):
    return positive(spark, sf)


@query(
    "qrels_last_wins",
    "SELECT dataset, query_id, corpus_id, score FROM (SELECT DISTINCT * FROM qrels) WHERE score > 0 AND query_id IS NOT NULL AND corpus_id IS NOT NULL "
    "QUALIFY row_number() OVER (PARTITION BY dataset, query_id, corpus_id ORDER BY loaded_at DESC, qrel_id DESC) = 1",
)
def qrels_last_wins(spark, sf):
    """Of repeated pairs the line loaded last."""
    q = table(spark, sf, "qrels").filter("score > 0 and query_id is not null and corpus_id is not null")
    return q.groupBy("dataset", "query_id", "corpus_id").agg(F.max_by("score", F.struct("loaded_at", "qrel_id")).alias("score"))


@query(
    "split_fallback",
    "WITH s AS (SELECT dataset, min(CASE split WHEN 'test' THEN 0 WHEN 'dev' THEN 1 WHEN 'train' THEN 2 END) AS p FROM qrels GROUP BY 1) "
    "SELECT dataset, (['test', 'dev', 'train'])[p + 1] AS split, count(DISTINCT qrel_id) AS lines FROM qrels JOIN s USING (dataset) "
    "WHERE split = (['test', 'dev', 'train'])[p + 1] GROUP BY ALL",
)
def split_fallback(spark, sf):
    """The first split that each dataset has, and its lines."""
    q = table(spark, sf, "qrels").select("dataset", "split", "qrel_id")
    place = F.array_position(F.array(*(F.lit(s) for s in readers.SPLITS)), F.col("split"))
    counts = q.filter(place > 0).groupBy("dataset", "split").agg(F.count_distinct("qrel_id").alias("lines"))
    return counts.groupBy("dataset").agg(F.min_by(F.struct("split", "lines"), place).alias("x")).select("dataset", "x.split", "x.lines")


@query("queries_with_qrels", f"WITH {POS} SELECT DISTINCT dataset, _id FROM queries q WHERE EXISTS (SELECT 1 FROM pos p WHERE p.dataset = q.dataset AND p.query_id = q._id)")
def queries_with_qrels(spark, sf):
    asked = positive(spark, sf).select("dataset", F.col("query_id").alias("_id")).distinct()
    return table(spark, sf, "queries").select("dataset", "_id").distinct().join(asked, ["dataset", "_id"], "left_semi")


@query(
    "queries_with_relevant_in_corpus",
    f"WITH {POS} SELECT DISTINCT dataset, _id FROM queries q WHERE EXISTS (SELECT 1 FROM pos p JOIN corpus c ON c.dataset = p.dataset AND c._id = p.corpus_id "
    f"WHERE p.dataset = q.dataset AND p.query_id = q._id)",
)
def queries_with_relevant(spark, sf):
    docs = table(spark, sf, "corpus").select("dataset", F.col("_id").alias("corpus_id")).distinct()
    asked = positive(spark, sf).join(docs, ["dataset", "corpus_id"], "left_semi").select("dataset", F.col("query_id").alias("_id")).distinct()
    return table(spark, sf, "queries").select("dataset", "_id").distinct().join(asked, ["dataset", "_id"], "left_semi")


@query("distractor_pool", f"WITH {POS} SELECT DISTINCT dataset, _id FROM corpus c WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE p.dataset = c.dataset AND p.corpus_id = c._id)")
def distractor_pool(spark, sf):
    relevant = positive(spark, sf).select("dataset", F.col("corpus_id").alias("_id")).distinct()
    return table(spark, sf, "corpus").select("dataset", "_id").distinct().join(relevant, ["dataset", "_id"], "left_anti")


@query(
    "id_set_ops",
    f"WITH {POS}, r AS (SELECT DISTINCT corpus_id AS id FROM pos), d AS (SELECT DISTINCT _id AS id FROM corpus) SELECT 'union' AS op, count(*) AS n FROM (SELECT id "
    f"FROM r UNION SELECT id FROM d) UNION ALL SELECT 'intersection', count(*) FROM (SELECT id FROM r INTERSECT SELECT id FROM d) UNION ALL "
    f"SELECT 'missing', count(*) FROM (SELECT id FROM r EXCEPT SELECT id FROM d)",
)
def id_set_ops(spark, sf):
    r, d = positive(spark, sf).select(F.col("corpus_id").alias("id")).distinct(), table(spark, sf, "corpus").select(F.col("_id").alias("id")).distinct()
    n = lambda df, op: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
    return n(r.union(d).distinct(), "union").unionByName(n(r.intersect(d), "intersection")).unionByName(n(r.subtract(d), "missing"))


_HASH = f"md5('{sampling.SEED}|' || {{}})"


def _subset_sql(n_queries: int, n_distractors: int) -> str:
    return f"""{POS}, drawn AS (SELECT dataset, query_id FROM (SELECT DISTINCT dataset, query_id FROM pos) QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY {_HASH.format('query_id')}, query_id) <= {n_queries}),
docs AS (SELECT DISTINCT dataset, _id AS corpus_id FROM corpus),
judged AS (SELECT p.* FROM pos p SEMI JOIN drawn d ON d.dataset = p.dataset AND d.query_id = p.query_id SEMI JOIN docs c ON c.dataset = p.dataset AND c.corpus_id = p.corpus_id),
rel AS (SELECT DISTINCT dataset, corpus_id FROM judged),
other AS (SELECT dataset, corpus_id FROM docs d WHERE NOT EXISTS (SELECT 1 FROM rel r WHERE r.dataset = d.dataset AND r.corpus_id = d.corpus_id) QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY {_HASH.format('corpus_id')}, corpus_id) <= {n_distractors})"""


SUB = _subset_sql(sampling.N_QUERIES, sampling.N_DISTRACTORS)


def parts(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return sampling.subsets(table(spark, sf, "corpus"), table(spark, sf, "queries"), positive(spark, sf))


@query("sample_queries_hash", f"WITH {SUB} SELECT * FROM drawn")
def sample_queries(spark, sf):
    return sampling.first_by_hash(positive(spark, sf).select("dataset", "query_id").distinct(), ["dataset"], "query_id", sampling.N_QUERIES)


@query("subset_corpus", f"WITH {SUB} SELECT dataset, corpus_id, true AS relevant FROM rel UNION ALL SELECT dataset, corpus_id, false FROM other")
def subset_corpus(spark, sf):
    return parts(spark, sf)["corpus"]


@query("subset_qrels", f"WITH {SUB} SELECT dataset, query_id, corpus_id, score FROM judged")
def subset_qrels(spark, sf):
    return parts(spark, sf)["qrels"].select("dataset", "query_id", "corpus_id", "score")


@query(
    "subset_build_info",
    f"""WITH {SUB}, k AS (SELECT dataset, count(*) AS corpus_written, sum(r) AS rel_docs, sum(1 - r) AS distractors FROM (SELECT dataset, 1 AS r FROM rel UNION ALL SELECT dataset, 0 FROM other) GROUP BY 1),
a AS (SELECT d.dataset, count(*) AS queries_written FROM drawn d SEMI JOIN queries q ON q.dataset = d.dataset AND q._id = d.query_id GROUP BY 1), j AS (SELECT dataset, count(*) AS qrels_rows FROM judged GROUP BY 1)
SELECT dataset, {sampling.N_QUERIES} AS queries_requested, coalesce(queries_written, 0) AS queries_written, coalesce(corpus_written, 0) AS corpus_written, CAST(coalesce(rel_docs, 0) AS BIGINT) AS rel_docs, CAST(coalesce(distractors, 0) AS BIGINT) AS distractors, coalesce(qrels_rows, 0) AS qrels_rows, {sampling.SEED} AS seed FROM k FULL JOIN a USING (dataset) FULL JOIN j USING (dataset)""",
)
def subset_build_info(spark, sf):
    return sampling.build_info(parts(spark, sf))


@query("build_info_json", ORACLES["subset_build_info"])
def build_info_json(spark, sf):
    """Sizes written as JSON objects and parsed again."""
    info = sampling.build_info(parts(spark, sf))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in info.schema)
    return info.select(F.from_json(F.to_json(F.struct("*")), fields).alias("r")).select("r.*")


_W = "JOIN (SELECT DISTINCT dataset, split, chunk, pos, ids FROM chunk_ids) i USING (dataset, split, chunk, pos)"


@query("chunk_rows", f"SELECT dataset, split, chunk, pos, ids AS id, CAST(len(vecs) AS INTEGER) AS dim FROM chunk_vecs v {_W}")
def chunk_rows(spark, sf):
    v = table(spark, sf, "chunk_vecs")
    n = table(spark, sf, "chunk_ids").select(*CHUNK_KEYS, F.col("ids").alias("id")).distinct()
    return v.select(*CHUNK_KEYS, F.when(F.col("vecs").isNotNull(), F.size("vecs")).alias("dim")).join(n, CHUNK_KEYS)


def unit_vectors(spark, sf, split: str | None = None) -> DataFrame:
    c = readers.chunk_table(table(spark, sf, "chunk_vecs"), table(spark, sf, "chunk_ids"), split)
    good = (F.size("v") == 64) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return c.filter(good).select("dataset", "split", "chunk", "pos", "id", F.transform(scaled(doubles(F.col("v")), SOURCE_EPS), lambda x: F.round(x, 6) + F.lit(0.0)).alias("v"))


@query(
    "normalised_vectors",
    f"""SELECT dataset, split, chunk, pos, ids AS id, list_transform(list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)), lambda z: round(z, 6) + 0.0) AS v FROM (SELECT dataset, split, chunk, pos, CAST(vecs AS DOUBLE[]) AS v FROM chunk_vecs WHERE len(vecs) = 64 AND len(list_filter(vecs, lambda x: x IS NULL OR NOT isfinite(x))) = 0) t {_W}""",
)
def normalised_vectors(spark, sf):
    """Query and passage vectors of untagged and tagged chunks at length 1."""
    return unit_vectors(spark, sf)


@query("chunk_sizes", "SELECT dataset, split, chunk, count(*) AS n FROM chunk_vecs GROUP BY ALL")
def chunk_sizes(spark, sf):
    """Sizes without reading a vector."""
    return table(spark, sf, "chunk_vecs").groupBy("dataset", "split", "chunk").agg(F.count(F.lit(1)).alias("n"))


@query("untagged_chunks", "SELECT DISTINCT dataset, split, chunk FROM chunk_vecs WHERE NOT contains(chunk, '.')")
def untagged_chunks(spark, sf):
    return table(spark, sf, "chunk_vecs").select("dataset", "split", "chunk").distinct().filter(F.regexp_extract("chunk", r"^[^.]+\.(.+)$", 1) == "")


@query("super_batches", "WITH s AS (SELECT dataset, split, chunk, count(*) AS n FROM chunk_vecs "
    "GROUP BY ALL), c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY dataset, split ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before "
    "FROM s) SELECT dataset, split, CAST(before // 1000 AS BIGINT) AS batch, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL")
def super_batches(spark, sf):
    """Consecutive chunks put together by the thousands of rows before them."""
    w = Window.partitionBy("dataset", "split").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    s = chunk_sizes(spark, sf).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return s.groupBy("dataset", "split", F.floor(F.col("before") / 1000).alias("batch")).agg(F.count(F.lit(1)).alias("chunks"), F.sum("n").alias("n"))


@query("ids_only", "SELECT DISTINCT ids AS id FROM chunk_ids WHERE ids IS NOT NULL")
def ids_only(spark, sf):
    return table(spark, sf, "chunk_ids").select(F.col("ids").alias("id")).filter("id is not null").distinct()


@query("subset_discovery", "SELECT dataset FROM corpus INTERSECT SELECT dataset FROM queries INTERSECT SELECT dataset FROM chunk_vecs WHERE split = 'corpus'")
def subset_discovery(spark, sf):
    """Datasets with passages, queries and vectors."""
    d = lambda t: table(spark, sf, t).select("dataset").distinct()
    return d("corpus").intersect(d("queries")).intersect(table(spark, sf, "chunk_vecs").filter("split = 'corpus'").select("dataset").distinct())


@query("missing_subsets", "SELECT w AS dataset FROM (VALUES ('nq'), ('quora'), ('msmarco')) t(w) WHERE w NOT IN (SELECT dataset FROM corpus)")
def missing_subsets(spark, sf):
    """Wanted datasets that aren't there."""
    wanted = spark.createDataFrame([("nq",), ("quora",), ("msmarco",)], "dataset string")
    return wanted.join(table(spark, sf, "corpus").select("dataset").distinct(), "dataset", "left_anti")


@query("not_yet_embedded", "SELECT DISTINCT dataset, _id FROM corpus c WHERE NOT EXISTS (SELECT 1 FROM chunk_ids i WHERE i.dataset = c.dataset AND i.split = 'corpus' AND i.ids = c._id)")
def not_yet_embedded(spark, sf):
    """Passages without a vector: what a resumed run still has to do."""
    done = table(spark, sf, "chunk_ids").filter("split = 'corpus'").select("dataset", F.col("ids").alias("_id")).distinct()
    return table(spark, sf, "corpus").select("dataset", "_id").distinct().join(done, ["dataset", "_id"], "left_anti")


@query(
    "first_vectors",
    f"SELECT dataset, split, chunk, pos, ids AS id FROM (SELECT dataset, split, chunk, pos FROM (SELECT DISTINCT dataset, split, chunk, pos FROM chunk_vecs) "
    f"QUALIFY row_number() OVER (PARTITION BY dataset, split ORDER BY chunk, pos) <= {MOST_ROWS}) {_W}",
)
def first_vectors(spark, sf):
    """The first rows of every dataset and split in the order of chunks and positions, as a row cap gives them."""
    w = Window.partitionBy("dataset", "split").orderBy("chunk", "pos")
    v = table(spark, sf, "chunk_vecs").select(*CHUNK_KEYS).distinct().withColumn("r", F.row_number().over(w)).filter(F.col("r") <= MOST_ROWS).drop("r")
    n = table(spark, sf, "chunk_ids").select(*CHUNK_KEYS, F.col("ids").alias("id")).distinct()
    return v.join(n, CHUNK_KEYS)


@query(
    "ideal_dcg",
    f"WITH {POS}, r AS (SELECT dataset || '/' || query_id AS q, score, row_number() OVER (PARTITION BY dataset, query_id ORDER BY score DESC, corpus_id) AS place "
    f"FROM pos) SELECT q AS query_id, count(*) AS relevant, round(sum(CASE WHEN place <= 10 THEN score / log2(place + 1) END), 6) AS idcg10 FROM r GROUP BY 1",
)
def ideal_dcg(spark, sf):
    q = positive(spark, sf).select(F.concat_ws("/", "dataset", "query_id").alias("query_id"), "corpus_id", "score")
    return metrics.ideal(q, [10]).select("query_id", "relevant", F.round("idcg10", 6).alias("idcg10"))


@query("grades", f"WITH {POS} SELECT dataset, score, count(*) AS n FROM pos GROUP BY ALL")
def grades(spark, sf):
    return positive(spark, sf).groupBy("dataset", "score").agg(F.count(F.lit(1)).alias("n"))


@query("table_counts", "SELECT 'corpus' AS t, count(*) AS n FROM corpus UNION ALL SELECT 'queries', count(*) FROM queries UNION ALL SELECT 'qrels', count(*) "
    "FROM qrels UNION ALL SELECT 'chunk_vecs', count(*) FROM chunk_vecs")
def table_counts(spark, sf):
    out = None
    for t in ("corpus", "queries", "qrels", "chunk_vecs"):
        n = table(spark, sf, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("t"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("embedded_queries", None)
def embedded_queries(spark, sf):
    """All passages and queries through the embedding interface, with the deterministic stand-in for a model."""
    keys = ["dataset", "split", "_id"]
    c = table(spark, sf, "corpus").select("dataset", F.lit("corpus").alias("split"), "_id", text.composed(F.col("title"), F.col("text")).alias("text"))
    q = table(spark, sf, "queries").select("dataset", F.lit("queries").alias("split"), "_id", "text")
    items = c.unionByName(q).groupBy(*keys).agg(F.max("text").alias("text"))
    items = items.select(F.to_json(F.struct(*keys)).alias("key"), text.truncated(F.col("text"), EMBED_TOKENS).alias("text"))
    v = readers.embed(items, "key", "text", readers.hashing_embedder(64), 64)
    return v.select(F.from_json("id", "dataset string, split string, _id string").alias("k"), "v").select("k.*", "v")
