"""Search, quality metrics and reports: the leaderboard of codecs over the embeddings table.

Every fiftieth row searches all rows. Relevant are the ten best by exact float32 search, graded by
rank, so metrics measure fidelity to exact search. Subsets are labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vektora.operators import calibration, metrics, report, schemes, scoring
from vektora.plans import vectors_sql as q
from vektora.plans.vector_queries import embeddings, stats
from vektora.plans.vectors_sql import DIM, EVERY
from vektora.session import materialize

QUERIES, ORACLES = {}, {}
FLAGSHIP = ("float32", "cart_int8", "angle_int8_uniform", "pos_clip_50pct", "cart_clip_50pct")
KS = (5, 10, 15, 20)
METRICS = [*(f"ndcg{k}" for k in KS), "recall100"]


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def searching(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings(spark, sf).filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("id"), "v")


def floats(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings(spark, sf).select(F.lit("float32").alias("scheme"), F.col("vec_id").alias("id"), "v")


def exact(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    """Graded judgements from the exact search: 3, 2 or 1."""
    r = scoring.topk(floats(spark, sf), searching(spark, sf), k)
    grade = F.when(F.col("rank") <= 2, 3).when(F.col("rank") <= 5, 2).otherwise(1)
    return r.select("query_id", F.col("doc_id").alias("corpus_id"), grade.alias("score"))


def chosen(names, s) -> list[schemes.Scheme]:
    found, missing = schemes.select(schemes.registry(DIM, s), names)
    if missing:
        raise ValueError(f"no such schemes: {missing}")
    return found


def ranking(spark: SparkSession, sf: str, names, k: int = 100) -> DataFrame:
    s = stats(spark, sf)
    return scoring.topk_schemes(embeddings(spark, sf), "vec_id", "v", DIM, chosen(names, s), s, searching(spark, sf), k)


def quality(spark: SparkSession, sf: str, names, by=("scheme",)) -> DataFrame:
    return metrics.per_query(materialize(ranking(spark, sf, names), "ranking").df, exact(spark, sf), by, KS)


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


BASE = f"{q.UPTO_STATS}, {q.QUERIES}, {q.FLOATS}, {q.EXACT}"


def _scored(names) -> str:
    return f"{BASE}, {q.union_decoded(chosen(names, None))}, rnk AS {q.ranked(100)}, {q.quality()}"


_R = ", ".join(f"round({m}, 6) AS {m}" for m in METRICS)
_AVG = ", ".join(f"avg({m}) AS {m}" for m in METRICS)
_BITS = ", ".join(f"('{s.name}', {s.bits_per_vec})" for s in schemes.registry(DIM))


@query("cosine_topk", f"WITH {q.VEC}, {q.QUERIES}, {q.FLOATS} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM {q.ranked(100, 'flt')}")
def cosine_topk(spark, sf):
    return scoring.topk(floats(spark, sf), searching(spark, sf), 100).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("cosine_topk_columns", ORACLES["cosine_topk"])
def cosine_topk_columns(spark, sf):
    return scoring.topk_columns(floats(spark, sf), searching(spark, sf), 100).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("topk_two_stage", ORACLES["cosine_topk"])
def topk_two_stage(spark, sf):
    """Top-k of each third of the documents, merged one after the other."""
    d, s, state = floats(spark, sf), searching(spark, sf), None
    for part in range(3):
        new = scoring.topk(d.filter(F.pmod(F.xxhash64("id"), F.lit(3)) == part), s, 100)
        state = new if state is None else scoring.merged(state, new, 100)
    return state.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("exact_judgements", f"WITH {q.VEC}, {q.QUERIES}, {q.FLOATS}, {q.EXACT} SELECT query_id, corpus_id, score FROM exact")
def exact_judgements(spark, sf):
    return exact(spark, sf)


@query("ndcg_at_k", f"WITH {_scored(['cart_int4'])} SELECT query_id, {', '.join(f'round(ndcg{k}, 6) AS ndcg{k}' for k in KS)} FROM perq")
def ndcg_at_k(spark, sf):
    return quality(spark, sf, ["cart_int4"]).select("query_id", *r6(*(f"ndcg{k}" for k in KS)))


@query("recall_at_100", f"WITH {_scored(['cart_int2'])} SELECT query_id, round(recall100, 6) AS recall100 FROM perq")
def recall_at_100(spark, sf):
    return quality(spark, sf, ["cart_int2"]).select("query_id", *r6("recall100"))


@query(
    "single_truth",
    f"WITH {BASE}, {q.union_decoded(chosen(['cart_int4', 'angle_int2_uniform'], None))}, rnk AS {q.ranked(1 << 62)}, n AS (SELECT count(*) AS n FROM vec) "
    f"SELECT s.scheme, round(avg(CASE WHEN rank = 1 THEN 1 ELSE 0 END), 6) AS r_at_1, round(avg(CASE "
    f"WHEN rank <= 10 THEN 1 ELSE 0 END), 6) AS r_at_k, round(avg(coalesce(rank, n.n)), 6) AS mean_rank FROM qry CROSS JOIN (SELECT DISTINCT scheme "
    f"FROM rnk) s CROSS JOIN n LEFT JOIN rnk r ON r.scheme = s.scheme AND r.query_id = qry.query_id AND r.doc_id = qry.query_id GROUP BY 1",
)
def single_truth(spark, sf):
    """Each query's truth is the row that it was, ranked among all rows."""
    stat, truth = stats(spark, sf), searching(spark, sf).select(F.col("id").alias("query_id"), F.col("id").alias("doc_id"))
    docs = schemes.decode_all(embeddings(spark, sf), "vec_id", "v", DIM, chosen(["cart_int4", "angle_int2_uniform"], stat), stat)
    r = scoring.truth_ranks(docs, searching(spark, sf), truth)
    return metrics.single_truth(r, truth, 10, embeddings(spark, sf).count()).select("scheme", *r6("r_at_1", "r_at_k", "mean_rank"))


def leaderboard(spark: SparkSession, sf: str, names) -> DataFrame:
    """Means of every metric per scheme with bits, ratio and share retained."""
    m = metrics.means(quality(spark, sf, names))
    bits = spark.createDataFrame([(s.name, s.bits_per_vec) for s in chosen(names, stats(spark, sf) if any(n.startswith("greedy") for n in names) else None)], "scheme string, bits_per_vec int")
    return report.with_baseline(m.join(F.broadcast(bits), "scheme"), "float32", "ndcg10")


def _board_sql(names) -> str:
    return f"WITH {_scored(names)}, res AS (SELECT scheme, bits_per_vec, {_AVG}, count(*) AS n_queries FROM perq JOIN (VALUES {_BITS}) b(scheme, bits_per_vec) USING (scheme) GROUP BY 1, 2)"


_BOARD = f" SELECT scheme, bits_per_vec, {_R}, n_queries, round({32 * DIM} / bits_per_vec, 6) AS compression_ratio, round(ndcg10 / (SELECT ndcg10 FROM res WHERE scheme = 'float32'), 6) AS retained FROM res"


def board(names):
    return lambda spark, sf: leaderboard(spark, sf, names).select("scheme", "bits_per_vec", *r6(*METRICS), "n_queries", *r6("compression_ratio", "retained"))


query("scheme_leaderboard", _board_sql(FLAGSHIP) + _BOARD)(board(FLAGSHIP))
#: Every scheme worth scoring but the tiers, whose allocation the SQL can't repeat.
WITHOUT_TIERS = tuple(s.name for s in schemes.distinct(schemes.registry(DIM))[0] if s.family != "tiers")
query("full_leaderboard", _board_sql(WITHOUT_TIERS) + _BOARD)(board(WITHOUT_TIERS))


_GREEDY_BITS = "SELECT 'greedy_' || budget || 'b' AS scheme, CAST(list_sum(w) AS INTEGER) AS bits_per_vec FROM tiers"
_NO_TIERS = f"SELECT * FROM (VALUES {', '.join(f'({chr(39)}{s.name}{chr(39)}, {s.bits_per_vec})' for s in schemes.registry(DIM) if s.family != 'tiers')}) b(scheme, bits_per_vec)"


@query(
    "all_schemes_leaderboard",
    f"WITH RECURSIVE {BASE}, {q.tiers_walk(schemes.BUDGETS)}, {q.union_decoded(chosen(WITHOUT_TIERS, None))[:-1]} "
    f"UNION ALL {q.union_tiers()}), rnk AS {q.ranked(100)}, {q.quality()}, bits AS ({_NO_TIERS} "
    f"UNION ALL {_GREEDY_BITS}), res AS (SELECT scheme, bits_per_vec, {_AVG}, count(*) AS n_queries FROM perq JOIN bits USING (scheme) GROUP BY 1, 2)" + _BOARD,
)
def all_schemes(spark, sf):
    """Every distinct scheme, tiers included."""
    return board([s.name for s in schemes.distinct(schemes.registry(DIM, stats(spark, sf)))[0]])(spark, sf)


_SERIES = "^(greedy|pos_clip|jac_clip|cart_clip|jac_trunc)"


@query("series_by_family", f"SELECT * FROM (SELECT regexp_extract(scheme, '{_SERIES}', 1) AS series, scheme, bits_per_vec, ndcg10, recall100 FROM ({ORACLES['all_schemes_leaderboard']})) WHERE series <> ''")
def series_by_family(spark, sf):
    """The series of figures: quality by bits within each family of schemes."""
    r = all_schemes(spark, sf).select(F.regexp_extract("scheme", _SERIES, 1).alias("series"), "scheme", "bits_per_vec", "ndcg10", "recall100")
    return r.filter("series <> ''")


_SYM = ("cart_int8", "cart_int4")


@query(
    "symmetric_vs_asymmetric",
    f"WITH {BASE}, {q.union_decoded(chosen(_SYM, None))}, sym AS (SELECT scheme || '_symmetric' AS scheme, vec_id, r "
    f"FROM dec), sq AS (SELECT scheme, vec_id AS query_id, r AS qv FROM sym WHERE vec_id % {EVERY} = 0), rnk AS (SELECT * FROM {q.ranked(100)} UNION ALL SELECT * "
    f"FROM {q.ranked(100, 'sym', 'sq', 'd.scheme = q.scheme')}), {q.quality()} SELECT scheme, {', '.join(f'round(avg({m}), 6) AS {m}' for m in METRICS)} FROM perq GROUP BY 1",
)
def symmetric(spark, sf):
    """Float queries against encoded documents, and both encoded."""
    docs = schemes.decode_all(embeddings(spark, sf), "vec_id", "v", DIM, chosen(_SYM, None), None)
    both = docs.withColumn("scheme", F.concat("scheme", F.lit("_symmetric")))
    asym = scoring.topk(docs, searching(spark, sf), 100)
    sym = scoring.topk(both, both.filter(F.col("id") % EVERY == 0), 100, "scheme")
    return metrics.means(metrics.per_query(asym.unionByName(sym), exact(spark, sf), ks=KS)).select("scheme", *r6(*METRICS))


def subset_results(spark: SparkSession, sf: str, names=FLAGSHIP) -> DataFrame:
    """Results per scheme and subset (the label of the searching row)."""
    label = embeddings(spark, sf).select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("subset"))
    m = metrics.means(quality(spark, sf, names).join(label, "query_id"), ("scheme", "subset"))
    bits = spark.createDataFrame([(s.name, s.bits_per_vec) for s in chosen(names, None)], "scheme string, bits_per_vec int")
    return report.with_baseline(m.join(F.broadcast(bits), "scheme"), "float32", "ndcg10", ["subset"])


_SUB = f"WITH {_scored(FLAGSHIP)}, sub AS (SELECT scheme, CAST(label AS VARCHAR) AS subset, bits_per_vec, {_AVG}, count(*) AS n_queries FROM perq JOIN vec ON vec_id = query_id JOIN (VALUES {_BITS}) b(scheme, bits_per_vec) USING (scheme) GROUP BY 1, 2, 3), full_ AS (SELECT s.*, {32 * DIM} / s.bits_per_vec AS compression_ratio, s.ndcg10 / b.ndcg10 AS retained FROM sub s JOIN sub b ON b.subset = s.subset AND b.scheme = 'float32')"


@query("rows_by_subset", f"{_SUB} SELECT scheme, subset, bits_per_vec, {_R}, n_queries, round(retained, 6) AS retained FROM full_")
def rows_by_subset(spark, sf):
    return subset_results(spark, sf).select("scheme", "subset", "bits_per_vec", *r6(*METRICS), "n_queries", *r6("retained"))


@query("baseline_by_subset", f"{_SUB} SELECT subset, {_R} FROM full_ WHERE scheme = 'float32'")
def baseline_by_subset(spark, sf):
    return subset_results(spark, sf, ["float32"]).select("subset", *r6(*METRICS))


@query("macro_by_scheme", f"{_SUB} SELECT scheme, bits_per_vec, round(compression_ratio, 6) AS compression_ratio, "
    f"{', '.join(f'round(avg({m}), 6) AS {m}' for m in METRICS)}, count(*) AS n_subsets FROM full_ GROUP BY scheme, bits_per_vec, compression_ratio")
def macro_by_scheme(spark, sf):
    return report.macro(subset_results(spark, sf), METRICS).select("scheme", "bits_per_vec", *r6("compression_ratio", *METRICS), "n_subsets")


@query("macro_rollup", f"{_SUB} SELECT scheme, subset, round(avg(ndcg10), 6) AS ndcg10, round(avg(recall100), 6) AS recall100, count(*) AS n FROM full_ "
    f"GROUP BY ROLLUP (scheme, subset) HAVING scheme IS NOT NULL")
def macro_rollup(spark, sf):
    return report.macro_rollup(subset_results(spark, sf), ["ndcg10", "recall100"]).select("scheme", "subset", *r6("ndcg10", "recall100"), "n")


@query(
    "results_text",
    f"{_board_sql(FLAGSHIP)} SELECT rpad(scheme, 40, ' ') || ' ' || lpad(CAST(bits_per_vec AS VARCHAR), 8, ' ') || ' ' || lpad(printf('%.2fx', {32 * DIM} / "
    f"bits_per_vec), 8, ' ') || ' ' || lpad(printf('%.4f', ndcg10), 9, ' ') || ' ' || lpad(printf('%.4f', recall100), 9, ' ') AS value FROM res",
)
def results_text(spark, sf):
    """Results as lines of a table of fixed width."""
    return report.fixed_width(leaderboard(spark, sf, FLAGSHIP), ["ndcg10", "recall100"])


STEPS = ("cart_int8", "cart_int4", "cart_clip_50pct", "cart_clip_80pct")


@query(
    "ablation_delta",
    f"{_board_sql(('float32', *STEPS))}, st AS (SELECT i, r.* FROM res r "
    f"JOIN (VALUES {', '.join(f'({i}, {chr(39)}{n}{chr(39)})' for i, n in enumerate(STEPS))}) s(i, scheme) USING (scheme)) "
    f"SELECT CAST(i AS INTEGER) AS step, scheme, bits_per_vec, round(ndcg10 - coalesce(lag(ndcg10) OVER (ORDER BY i), (SELECT ndcg10 FROM res "
    f"WHERE scheme = 'float32')), 6) AS delta, round(first(bits_per_vec) OVER (ORDER BY i) / bits_per_vec, 6) AS ratio_first, round({32 * DIM} / bits_per_vec, 6) AS ratio_float32 FROM st",
)
def ablation_delta(spark, sf):
    b = materialize(leaderboard(spark, sf, ("float32", *STEPS)).select("scheme", "bits_per_vec", "ndcg10"), "board").df
    base = b.filter("scheme = 'float32'").first()["ndcg10"]
    order = spark.createDataFrame(list(enumerate(STEPS)), "step int, scheme string")
    return report.ablation(b.join(order, "scheme"), "step", "ndcg10", base, 32 * DIM).select("step", "scheme", "bits_per_vec", *r6("delta", "ratio_first", "ratio_float32"))


def _clips(percents) -> list[str]:
    return [f"{p}_clip_{c}pct" for c in percents for p in ("pos", "jac")]


_PERCENTS = _clips(schemes.CLIPS)


@query(
    "tradeoff_table",
    f"{_board_sql(_PERCENTS)}, p AS (SELECT CAST(regexp_extract(scheme, '([0-9]+)pct', 1) AS INTEGER) AS clip_pct, * FROM res) "
    f"SELECT x.clip_pct, y.bits_per_vec, round({32 * DIM} / y.bits_per_vec, 6) AS compression_ratio, round(x.ndcg10, 6) AS ndcg10_pos, round(y.ndcg10, 6) AS "
    f"ndcg10_jac, round(y.ndcg10 - x.ndcg10, 6) + 0.0 AS delta, round(({4 * DIM} - y.bits_per_vec / 8) * {report.FULL_SIZE} / 1e6, 6) AS mb_saved FROM p x "
    f"JOIN p y USING (clip_pct) WHERE x.scheme LIKE 'pos%' AND y.scheme LIKE 'jac%'",
)
def tradeoff_table(spark, sf):
    b = materialize(leaderboard_of(spark, sf, _PERCENTS), "board").df
    t = report.tradeoff(b.filter("scheme like 'pos%'"), b.filter("scheme like 'jac%'"), "ndcg10", DIM)
    return t.select("clip_pct", "bits_per_vec", *r6("compression_ratio", "ndcg10_pos", "ndcg10_jac"), (F.round("delta", 6) + 0.0).alias("delta"), *r6("mb_saved"))


def leaderboard_of(spark: SparkSession, sf: str, names) -> DataFrame:
    m = metrics.means(quality(spark, sf, names))
    return m.join(F.broadcast(spark.createDataFrame([(s.name, s.bits_per_vec) for s in chosen(names, None)], "scheme string, bits_per_vec int")), "scheme")


@query(
    "pareto_frontier",
    f"{_board_sql(WITHOUT_TIERS)} SELECT scheme, bits_per_vec, round(ndcg10, 6) AS ndcg10 FROM res a WHERE NOT EXISTS (SELECT 1 FROM res b "
    f"WHERE (b.bits_per_vec <= a.bits_per_vec AND round(b.ndcg10, 9) > round(a.ndcg10, 9)) OR (b.bits_per_vec < a.bits_per_vec AND round(b.ndcg10, 9) >= round(a.ndcg10, 9)))",
)
def pareto_frontier(spark, sf):
    b = leaderboard_of(spark, sf, WITHOUT_TIERS).withColumn("ndcg10", F.round("ndcg10", 9))
    return report.pareto(b, "ndcg10").select("scheme", "bits_per_vec", *r6("ndcg10"))


@query("label_percent", f"SELECT scheme, CAST(nullif(regexp_extract(scheme, '([0-9]+)(%|pct)', 1), '') AS INTEGER) AS pct FROM (VALUES {_BITS}) b(scheme, bits_per_vec)")
def label_percent(spark, sf):
    names = spark.createDataFrame([(s.name,) for s in schemes.registry(DIM)], "scheme string")
    return names.select("scheme", report.percent_of(F.col("scheme")).alias("pct"))


def _stream(spark: SparkSession, sf: str):
    """A folder into which the embeddings arrive as several files, and folders for state and checkpoint."""
    from vektora.session import scratch

    base = scratch(spark, "stream")
    embeddings(spark, sf).select(F.col("vec_id").alias("id"), "v").repartition(4, "id").write.parquet(f"{base}/in")
    return base


@query("incremental_stats", f"WITH {q.UPTO_STATS} SELECT CAST(pos AS INTEGER) AS pos, round(mean_angle, 6) AS mean_angle, round(sens, 6) AS sens FROM stats")
def incremental_stats(spark, sf):
    from vektora.streaming import incremental as inc

    base = _stream(spark, sf)
    state = inc.State(spark, f"{base}/state", {"dim": DIM})
    inc.run(spark, f"{base}/in", "id bigint, v array<double>", inc.statistics_step(state, DIM), f"{base}/checkpoint")
    return inc.finished_statistics(state).select("pos", *r6("mean_angle", "sens"))


@query("streaming_topk", ORACLES["cosine_topk"])
def streaming_topk(spark, sf):
    from vektora.streaming import incremental as inc

    base = _stream(spark, sf)
    state = inc.State(spark, f"{base}/state", {"k": 100, "schemes": ["float32"]})
    decode = lambda b: b.select(F.lit("float32").alias("scheme"), "id", "v")
    inc.run(spark, f"{base}/in", "id bigint, v array<double>", inc.topk_step(state, searching(spark, sf), 100, decode), f"{base}/checkpoint")
    return state.read().select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    "streaming_schemes",
    f"WITH {q.UPTO_STATS}, {q.QUERIES}, {q.union_decoded(chosen(FLAGSHIP, None))} "
    f"SELECT scheme, query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM {q.ranked(100)}",
)
def streaming_schemes(spark, sf):
    """Statistics, then the top-k of several schemes, both grown by super-batches of files."""
    from vektora.sources import readers
    from vektora.streaming import incremental as inc

    base = _stream(spark, sf)
    files = [f"{base}/in/{n}" for n in readers.listing(spark, f"{base}/in") if n.endswith(".parquet")]
    batches = readers.super_batches([(f, spark.read.parquet(f).count()) for f in files], max(1, embeddings(spark, sf).count() // 3))
    first = inc.State(spark, f"{base}/statistics", {"dim": DIM})
    read = lambda paths: spark.read.parquet(*paths)
    inc.run_super_batches(batches, read, inc.statistics_step(first, DIM), first)
    stat = calibration.collect(inc.finished_statistics(first, rank=True))
    second = inc.State(spark, f"{base}/scores", {"k": 100, "schemes": list(FLAGSHIP)})
    inc.run_super_batches(batches, read, inc.schemes_step(second, searching(spark, sf), 100, DIM, chosen(FLAGSHIP, stat), stat), second)
    return second.read().select("scheme", "query_id", "doc_id", F.round("score", 6).alias("score"), "rank")
