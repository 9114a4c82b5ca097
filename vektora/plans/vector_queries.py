"""Geometry, statistics, codecs and allocation over the embeddings table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vektora.functions import codecs
from vektora.functions.vectors import doubles, from_angles, literal, norm, ranges, tails, to_angles
from vektora.operators import allocation, calibration, schemes, stored
from vektora.plans import vectors_sql as q
from vektora.plans.vectors_sql import DIM
from vektora.session import spread

DIGITS = 6


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", doubles(F.col("embedding")).alias("v")))


def stats(spark: SparkSession, sf: str) -> calibration.Calibration:
    return calibration.collect(calibration.angle_statistics(embeddings(spark, sf), "v", DIM))


def rounded(v: Column) -> Column:
    """Rounded for comparison; adding 0 turns -0 into 0."""
    return F.transform(v, lambda x: F.round(x, DIGITS) + F.lit(0.0))


R = "list_transform({}, lambda z: round(z, 6) + 0.0)"
TOPS = ranges(DIM)
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


@query("scan_vectors", f"WITH {q.VEC} SELECT vec_id, CAST(len(v) AS INTEGER) AS dim, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm FROM vec")
def scan_vectors(spark, sf):
    return embeddings(spark, sf).select("vec_id", F.size("v").alias("dim"), F.round(norm(F.col("v")), DIGITS).alias("norm"))


@query("suffix_norms", f"WITH {q.VEC}, {q.TAILS} SELECT vec_id, {R.format('s')} AS tails FROM tails")
def suffix_norms(spark, sf):
    return embeddings(spark, sf).select("vec_id", rounded(tails(F.col("v"))).alias("tails"))


@query("to_angles", f"WITH {q.UPTO_ANGLES} SELECT vec_id, {R.format('a')} AS angles FROM ang")
def angles(spark, sf):
    return embeddings(spark, sf).select("vec_id", rounded(to_angles(F.col("v"), DIM)).alias("angles"))


@query("angle_roundtrip_error", f"WITH {q.UPTO_ANGLES} SELECT count(*) AS n, round(avg(list_distance(v, {q.from_angles('a')})), 6) AS error FROM ang")
def roundtrip(spark, sf):
    x = embeddings(spark, sf).select("v", from_angles(to_angles(F.col("v"), DIM), renormalise=False).alias("r"))
    return x.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(norm(F.zip_with("v", "r", lambda a, b: a - b))), DIGITS).alias("error"))


@query("angle_mean_std", f"WITH {q.UPTO_STATS} SELECT CAST(pos AS INTEGER) AS pos, round(mean_angle, 6) AS mean_angle, round(std_angle, 6) AS std_angle FROM stats")
def mean_std(spark, sf):
    return calibration.angle_statistics(embeddings(spark, sf), "v", DIM).select("pos", F.round("mean_angle", DIGITS).alias("mean_angle"), F.round("std_angle", DIGITS).alias("std_angle"))


@query("sensitivity_rank", f"WITH {q.UPTO_STATS} SELECT CAST(pos AS INTEGER) AS pos, round(sens, 6) AS sens, CAST(rank AS INTEGER) AS rank FROM stats")
def sensitivity(spark, sf):
    return calibration.angle_statistics(embeddings(spark, sf), "v", DIM).select("pos", F.round("sens", DIGITS).alias("sens"), "rank")


@query(
    "sensitivity_by_label",
    f"WITH {q.VEC}, {q.TAILS}, {q.ANGLES}, {q.LONG}, b AS (SELECT label, pos, avg(cum) AS m, avg(angle) AS a FROM cum JOIN vec USING (vec_id) GROUP BY ALL) "
    f"SELECT label, CAST(pos AS INTEGER) AS pos, round(a, 6) AS mean_angle, round(exp(m - max(m) OVER (PARTITION BY label)), 6) AS sens FROM b",
)
def sensitivity_by_label(spark, sf):
    s = calibration.angle_statistics(embeddings(spark, sf), "v", DIM, by=["label"])
    return s.select("label", "pos", F.round("mean_angle", DIGITS).alias("mean_angle"), F.round("sens", DIGITS).alias("sens"))


@query(
    "sensitivity_chunk_weighted",
    f"WITH {q.VEC}, {q.TAILS}, {q.ANGLES}, {q.LONG}, b AS (SELECT pos, avg(m) AS m FROM (SELECT label, pos, avg(cum) AS m FROM cum JOIN vec USING (vec_id) "
    f"GROUP BY ALL) GROUP BY pos) SELECT CAST(pos AS INTEGER) AS pos, round(exp(m - max(m) OVER ()), 6) AS sens FROM b",
)
def sensitivity_chunks(spark, sf):
    return calibration.angle_statistics(embeddings(spark, sf), "v", DIM, chunk="label").select("pos", F.round("sens", DIGITS).alias("sens"))


@query("anisotropy_profile", f"WITH {q.UPTO_STATS} SELECT CAST(pos AS INTEGER) AS pos, round(std_angle * std_angle, 6) AS variance FROM stats")
def anisotropy(spark, sf):
    return calibration.angle_statistics(embeddings(spark, sf), "v", DIM).select("pos", F.round(F.col("std_angle") * F.col("std_angle"), DIGITS).alias("variance"))


@query("angle_spread", f"WITH {q.UPTO_STATS} SELECT round(min(std_angle), 6) AS low, round(median(std_angle), 6) AS middle, round(max(std_angle), 6) AS high FROM stats")
def spread_of_angles(spark, sf):
    s = calibration.angle_statistics(embeddings(spark, sf), "v", DIM)
    return s.agg(F.round(F.min("std_angle"), DIGITS).alias("low"), F.round(F.percentile("std_angle", 0.5), DIGITS).alias("middle"), F.round(F.max("std_angle"), DIGITS).alias("high"))


def _cartesian(bits: int):
    def run(spark, sf):
        v = embeddings(spark, sf)
        return v.select("vec_id", codecs.shifted_codes(F.col("v"), bits).alias("codes"), rounded(codecs.cartesian(F.col("v"), bits)).alias("decoded"))

    sql = f"WITH {q.VEC} SELECT vec_id, CAST({q.shifted('v', bits)} AS INTEGER[]) AS codes, {R.format(q.unit('x'))} AS decoded FROM (SELECT vec_id, v, {q.shifted_values('v', bits)} AS x FROM vec)"
    query(f"cart_int{bits}", sql)(run)


def _uniform(bits: int):
    def run(spark, sf):
        a = embeddings(spark, sf).select("vec_id", to_angles(F.col("v"), DIM).alias("a"))
        return a.select("vec_id", codecs.angle_codes(F.col("a"), TOPS, bits).alias("codes"), rounded(from_angles(codecs.angle_uniform(F.col("a"), TOPS, bits))).alias("decoded"))

    s = schemes.Scheme("", "angle", 0, bits)
    codes = f"list_transform(range(1, {DIM}), lambda i: CAST({q.code('a[i]', bits)} AS INTEGER))"
    sql = f"WITH {q.UPTO_ANGLES} SELECT vec_id, codes, {R.format(q.unit('x'))} AS decoded FROM (SELECT vec_id, codes, {q.from_angles('c')} AS x FROM (SELECT vec_id, {codes} AS codes, {q.decoded_angles(s)} AS c FROM ang))"
    query(f"angle_int{bits}", sql)(run)


for _b in (8, 4, 2):
    _cartesian(_b)
    _uniform(_b)


@query("cart_centred_int8", f"WITH {q.VEC} SELECT vec_id, {R.format(q.unit('x'))} AS decoded "
    f"FROM (SELECT vec_id, list_transform(v, lambda x: round_even(greatest(-1.0, least(1.0, x)) * 127.5 + 127.5, 0) / 127.5 - 1) AS x FROM vec)")
def centred(spark, sf):
    return embeddings(spark, sf).select("vec_id", rounded(codecs.cartesian_centred(F.col("v"), 8)).alias("decoded"))


@query("sym_int8", f"WITH {q.VEC} SELECT vec_id, {R.format(q.unit('x'))} AS decoded "
    f"FROM (SELECT vec_id, list_transform(v, lambda x: round_even(greatest(-1.0, least(1.0, x)) * 127, 0) / 127) AS x FROM vec)")
def sym_int8(spark, sf):
    return embeddings(spark, sf).select("vec_id", rounded(codecs.symmetric_int8(F.col("v"))).alias("decoded"))


def _family(name: str, pick, needs_stats: bool = True):
    """All schemes of a family, decoded."""

    def run(spark, sf):
        s = stats(spark, sf) if needs_stats else None
        chosen = [x for x in schemes.registry(DIM, s) if pick(x.name)]
        return schemes.decode_all(embeddings(spark, sf), "vec_id", "v", DIM, chosen, s).select("scheme", F.col("id").alias("vec_id"), rounded(F.col("v")).alias("decoded"))

    chosen = [x for x in schemes.registry(DIM) if pick(x.name)]
    query(name, f"WITH {q.UPTO_STATS}, {q.union_decoded(chosen)} SELECT scheme, vec_id, {R.format('r')} AS decoded FROM dec")(run)


_family("cart_clip", lambda n: n.startswith("cart_clip") and not n.endswith("f32"), False)
_family("cart_clip_f32", lambda n: n.startswith("cart_clip") and n.endswith("f32"), False)
_family("pos_clip_mean", lambda n: n.startswith("pos_clip") and not n.endswith("zero"))
_family("pos_clip_zero", lambda n: n.startswith("pos_clip") and n.endswith("zero"))
_family("jac_clip", lambda n: n.startswith("jac_clip"))
_family("jac_trunc", lambda n: n.startswith("jac_trunc"))


_PAIRED = [x for x in schemes.registry(DIM) if x.name in {f"{p}_clip_{c}pct" for p in ("jac", "pos") for c in (20, 50, 80)}]


@query(
    "jac_equals_pos",
    f"WITH {q.UPTO_STATS}, {q.union_decoded(_PAIRED)} SELECT (SELECT count(*) FROM stats WHERE rank <> pos) AS moved, CAST(count(*) AS INTEGER) AS differing "
    f"FROM dec a JOIN dec b ON a.vec_id = b.vec_id AND a.scheme[5:] = b.scheme[5:] AND a.scheme LIKE 'jac%' AND b.scheme LIKE 'pos%' WHERE list_distance(a.r, b.r) > 1e-9",
)
def jac_equals_pos(spark, sf):
    """Angles whose rank isn't their position, and reconstructed rows that differ between the two families."""
    s = stats(spark, sf)
    pairs = {x.name: x for x in schemes.registry(DIM, s)}
    both = [pairs[f"{p}_clip_{c}pct"] for c in (20, 50, 80) for p in ("jac", "pos")]
    d = schemes.decode_all(embeddings(spark, sf), "vec_id", "v", DIM, both, s).select(F.substring("scheme", 5, 100).alias("c"), F.col("scheme").startswith("jac").alias("jac"), "id", "v")
    pair = d.groupBy("c", "id").agg(F.max(F.when(F.col("jac"), F.col("v"))).alias("x"), F.max(F.when(~F.col("jac"), F.col("v"))).alias("y"))
    differing = pair.filter(norm(F.zip_with("x", "y", lambda a, b: a - b)) > 1e-9).agg(F.count(F.lit(1)).alias("differing"))
    moved = sum(r != i for i, r in enumerate(s.rank))
    return differing.select(F.lit(moved).cast("bigint").alias("moved"), F.col("differing").cast("int").alias("differing"))


WIDTHS_BUDGET = 4 * (DIM - 1)
WIDTHS = allocation.proportional_bits(DIM - 1, WIDTHS_BUDGET)
_ROOTS = f"SELECT i - 1 AS pos, sqrt({DIM} - i) * {WIDTHS_BUDGET} / (SELECT sum(sqrt({DIM} - j)) FROM range(1, {DIM}) u(j)) AS share FROM range(1, {DIM}) t(i)"
_LOGS = f"SELECT pos, l * {WIDTHS_BUDGET} / sum(l) OVER () AS share FROM (SELECT pos, log2(greatest(std_angle, 1e-6)) - min(log2(greatest(std_angle, 1e-6))) OVER () + 0.1 AS l FROM stats)"


@query(
    "angle_var_bits",
    f"WITH {q.UPTO_ANGLES}, {q.proportional(_ROOTS, WIDTHS_BUDGET)}, w AS (SELECT list(bits ORDER BY pos) AS w FROM widths) SELECT vec_id, {R.format('c')} AS angles "
    f"FROM (SELECT vec_id, list_transform(range(1, {DIM}), lambda i: {q.middle('a[i]', 'w[i]')}) AS c FROM ang, w)",
)
def var_bits(spark, sf):
    """Every angle with its own width, in proportion to the coordinates it bears on."""
    a = embeddings(spark, sf).select("vec_id", to_angles(F.col("v"), DIM).alias("a"))
    return a.select("vec_id", rounded(codecs.angle_widths(F.col("a"), TOPS, WIDTHS)).alias("angles"))


@query("proportional_bits", f"WITH {q.proportional(_ROOTS, WIDTHS_BUDGET)} SELECT CAST(pos AS INTEGER) AS pos, bits FROM widths")
def proportional(spark, sf):
    return spark.createDataFrame(list(enumerate(WIDTHS)), "pos int, bits int")


@query("proportional_bits_std", f"WITH {q.UPTO_STATS}, {q.proportional(_LOGS, WIDTHS_BUDGET)} SELECT CAST(pos AS INTEGER) AS pos, bits FROM widths")
def proportional_std(spark, sf):
    """The same by the angles' deviations."""
    rows = sorted(calibration.angle_statistics(embeddings(spark, sf), "v", DIM).select("pos", "std_angle").collect())
    return spark.createDataFrame(list(enumerate(allocation.proportional_bits(DIM - 1, WIDTHS_BUDGET, [r["std_angle"] for r in rows]))), "pos int, bits int")


#: Budgets that fit vectors of 64 numbers: 2, 4 and 6 bits an angle.
SMALL_BUDGETS = (126, 252, 378)
_TIERS = f"WITH RECURSIVE {q.UPTO_STATS}, {q.tiers_walk(SMALL_BUDGETS)}"
_TIER_ROWS = f"rows_ AS (SELECT 'greedy_' || budget || 'b' AS scheme, CAST(i - 1 AS INTEGER) AS pos, CAST(w[i] AS INTEGER) AS bits FROM tiers, range(1, {DIM}) t(i))"


def tiers_table(spark, sf) -> DataFrame:
    s = stats(spark, sf)
    rows = [(f"greedy_{b}b", i, t) for b in SMALL_BUDGETS for i, t in enumerate(allocation.greedy_tiers(s.sens, TOPS, b))]
    return spark.createDataFrame(rows, "scheme string, pos int, bits int")


query("greedy_tiers", f"{_TIERS}, {_TIER_ROWS} SELECT * FROM rows_")(tiers_table)


@query("tier_histogram", f"{_TIERS}, {_TIER_ROWS} SELECT scheme, bits, count(*) AS angles FROM rows_ GROUP BY ALL")
def tier_histogram(spark, sf):
    from vektora.operators.report import tier_histogram as histogram

    return histogram(tiers_table(spark, sf))


@query("greedy_decode", f"{_TIERS} SELECT scheme, vec_id, {R.format('r')} AS decoded FROM ({q.union_tiers()})")
def greedy_decode(spark, sf):
    s = stats(spark, sf)
    chosen = [x for x in schemes.registry(DIM, s, SMALL_BUDGETS) if x.family == "tiers"]
    return schemes.decode_all(embeddings(spark, sf), "vec_id", "v", DIM, chosen, s).select("scheme", F.col("id").alias("vec_id"), rounded(F.col("v")).alias("decoded"))


#: Tiers of every kind in turn, to check their decoding in SQL.
CYCLE = schemes.Scheme("cycle", "tiers", 0, tiers=tuple(codecs.TIERS[i % 6] for i in range(DIM - 1)))


@query("tier_decode", f"WITH {q.UPTO_STATS}, {q.union_decoded([CYCLE])} SELECT vec_id, {R.format('r')} AS decoded FROM dec")
def tier_decode(spark, sf):
    s = stats(spark, sf)
    return schemes.decode_all(embeddings(spark, sf), "vec_id", "v", DIM, [CYCLE], s).select(F.col("id").alias("vec_id"), rounded(F.col("v")).alias("decoded"))


_W = "[" + ", ".join(map(str, CYCLE.tiers)) + "]"
_OF = f"list_transform(list_filter(range(1, {DIM}), lambda i: {_W}[i] = {{b}}), lambda i: {{x}})"
_CODES = ", ".join(f"{_OF.format(b=b, x='CAST(' + q.code('a[i]', b) + ' AS INTEGER)')} AS codes{b}" for b in (2, 4, 8))


@query(
    "stored_codes",
    f"WITH {q.UPTO_ANGLES} SELECT vec_id, {_CODES}, {_OF.format(b=16, x='round(' + q.half('a[i]') + ', 6)')} AS halves, "
    f"{_OF.format(b=32, x='round(CAST(CAST(a[i] AS FLOAT) AS DOUBLE), 6)')} AS floats, CAST(ceil({sum(CYCLE.tiers)} / 8) AS INTEGER) AS packed_bytes FROM ang",
)
def stored_codes(spark, sf):
    """What is stored of each vector by tiers of every kind, and the size of its packed form."""
    v, t = embeddings(spark, sf), CYCLE.tiers
    size = stored.pack(v, "vec_id", "v", DIM, t).select("vec_id", F.length("packed").alias("packed_bytes"))
    r6 = lambda c: F.transform(c, lambda x: F.round(x.cast("double"), 6)).alias(c)
    return stored.encode(v, "vec_id", "v", DIM, t).join(size, "vec_id").select("vec_id", "codes2", "codes4", "codes8", r6("halves"), r6("floats"), "packed_bytes")


@query(
    "stored_round_trip",
    f"WITH {q.UPTO_STATS} SELECT vec_id, {R.format('r')} AS decoded FROM (SELECT vec_id, {q.unit('x')} AS r FROM (SELECT vec_id, {q.from_angles('c')} AS x "
    f"FROM (SELECT vec_id, list_transform(range(1, {DIM}), lambda i: CASE WHEN {_W}[i] = 32 THEN CAST(CAST(a[i] AS FLOAT) AS DOUBLE) ELSE d[i] END) AS c "
    f"FROM (SELECT vec_id, a, {q.decoded_tiers(_W)} AS d FROM ang, arr))))",
)
def stored_round_trip(spark, sf):
    """The vectors that come back from their packed bits."""
    v, t = embeddings(spark, sf), CYCLE.tiers
    back = stored.unpack(stored.pack(v, "vec_id", "v", DIM, t), "vec_id", DIM, t, stats(spark, sf).means)
    return back.select("vec_id", rounded(F.col("v")).alias("decoded"))


@query("float16_round", f"WITH {q.UPTO_ANGLES} SELECT vec_id, list_transform(a, lambda t: {q.half('t')}) AS halves FROM ang")
def float16(spark, sf):
    return embeddings(spark, sf).select("vec_id", F.transform(to_angles(F.col("v"), DIM), codecs.half).alias("halves"))


_STAGE = f"stage AS (SELECT vec_id, v, {q.unit('x')} AS y FROM (SELECT vec_id, v, {q.shifted_values('v', 4)} AS x FROM vec)), res AS (SELECT vec_id, v, y, list_transform(range(1, {DIM + 1}), lambda i: v[i] - y[i]) AS r FROM stage), big AS (SELECT *, list_max(list_transform(r, lambda x: abs(x))) AS m FROM res)"


_CODED = f"list_transform(range(1, {DIM + 1}), lambda i: y[i] + greatest(-127, least(127, round_even(r[i] / s, 0))) * s)"


def _residual_sql(largest: str) -> str:
    return f"WITH {q.VEC}, {_STAGE} SELECT vec_id, {R.format(q.unit('x', '1e-12'))} AS decoded FROM (SELECT vec_id, {_CODED} AS x FROM (SELECT *, greatest({largest}, 1e-12) / 127 AS s FROM big))"


@query("residual_int8_vector", _residual_sql("m"))
def residual_vector(spark, sf):
    """int4 plus an int8 residual scaled for each vector."""
    x = embeddings(spark, sf).withColumn("y", codecs.cartesian(F.col("v"), 4))
    return x.select("vec_id", rounded(codecs.with_residual(F.col("v"), F.col("y"))).alias("decoded"))


def _with_largest(spark, sf) -> DataFrame:
    """Vectors, their int4 stage and the largest residual of all, one number that meets every row."""
    x = embeddings(spark, sf).withColumn("y", codecs.cartesian(F.col("v"), 4))
    return x.crossJoin(F.broadcast(x.agg(F.max(codecs.largest_residual(F.col("v"), F.col("y"))).alias("most"))))


@query("residual_int8_global", _residual_sql("(SELECT max(m) FROM big)"))
def residual_global(spark, sf):
    """The same with one scale for all."""
    return _with_largest(spark, sf).select("vec_id", rounded(codecs.with_residual(F.col("v"), F.col("y"), F.col("most"))).alias("decoded"))


@query(
    "residual_int8_raw",
    f"WITH {q.VEC}, {_STAGE} SELECT vec_id, {R.format('x')} AS decoded, round(s, 9) AS scale FROM (SELECT vec_id, s, {_CODED} AS x FROM (SELECT *, (SELECT max(m) FROM big) / 127 AS s FROM big))",
)
def residual_raw(spark, sf):
    """With one scale, as it comes from the decoder, beside the scale that has to be stored."""
    x = _with_largest(spark, sf)
    decoded = codecs.with_residual(F.col("v"), F.col("y"), F.col("most"), renormalise=False)
    return x.select("vec_id", rounded(decoded).alias("decoded"), F.round(codecs.residual_scale(F.col("most")), 9).alias("scale"))


_REG = schemes.registry(1536)
_ALIAS = schemes.distinct(_REG)[1]


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


#: Published costs at 1,536 numbers: fixed values (name, bits per vector).
KNOWN_BITS = (
    ("float32", 49152), ("cart_clip_20pct_f32", 39328), ("cart_clip_40pct_f32", 29504), ("cart_clip_50pct_f32", 24576), ("cart_clip_60pct_f32", 19648), ("cart_int8", 12288),
    ("angle_int8_uniform", 12280), ("cart_clip_20pct", 9832), ("jac_clip_20pct", 9824), ("cart_clip_80pct_f32", 9824), ("jac_trunc_int8_keep70pct", 8592), ("cart_clip_40pct", 7376),
    ("pos_clip_40pct", 7368), ("cart_int4", 6144), ("cart_clip_50pct", 6144), ("pos_clip_50pct_zero", 6144), ("angle_int4_uniform", 6140), ("cart_clip_60pct", 4912), ("jac_clip_60pct", 4912),
    ("jac_trunc_int4_keep70pct", 4296), ("jac_trunc_int8_keep30pct", 3680), ("cart_int2", 3072), ("jac_trunc_int4_keep50pct", 3072), ("angle_int2_uniform", 3070), ("cart_clip_80pct", 2456),
    ("pos_clip_80pct", 2456), ("jac_trunc_int2_keep70pct", 2148), ("jac_trunc_int4_keep30pct", 1840), ("jac_trunc_int2_keep50pct", 1536), ("jac_trunc_int2_keep30pct", 920),
)
#: Published equivalences at 1,536 numbers: fixed values.
KNOWN_ALIASES = (
    ("jac_clip_0pct", "angle_int8_uniform"), ("pos_clip_0pct", "angle_int8_uniform"), ("pos_clip_0pct_zero", "angle_int8_uniform"), ("cart_clip_0pct", "cart_int8"),
    ("jac_trunc_int8_keep50pct", "jac_clip_50pct"), ("jac_trunc_int8_keep100pct", "angle_int8_uniform"), ("jac_trunc_int4_keep100pct", "angle_int4_uniform"), ("jac_trunc_int2_keep100pct", "angle_int2_uniform"),
)


_N = 1536
_KEPT = "CAST(round_even({n} * (1 - p / 100.0), 0) AS INTEGER)"
_REGISTRY_SQL = f"""
SELECT 'float32' AS scheme, {32 * _N} AS bits_per_vec UNION ALL SELECT 'cart_int' || b, b * {_N} FROM (VALUES (8), (4), (2)) t(b) UNION ALL SELECT 'angle_int' || b || '_uniform', b * {_N - 1} FROM (VALUES (8), (4), (2)) t(b)
UNION ALL SELECT f || '_clip_' || p || 'pct' || z, 8 * {_KEPT.format(n=_N - 1)} FROM (VALUES ('jac', ''), ('pos', ''), ('pos', '_zero')) f(f, z), (VALUES {', '.join(f'({c})' for c in schemes.CLIPS)}) t(p)
UNION ALL SELECT 'cart_clip_' || p || 'pct' || z, b * {_KEPT.format(n=_N)} FROM (VALUES ('', 8), ('_f32', 32)) f(z, b), (VALUES {', '.join(f'({c})' for c in schemes.CLIPS)}) t(p) WHERE p > 0 OR b = 8
UNION ALL SELECT 'greedy_' || b || 'b', b FROM (VALUES {', '.join(f'({b})' for b in schemes.BUDGETS)}) t(b)
UNION ALL SELECT 'jac_trunc_int' || b || '_keep' || p || 'pct', b * CAST(round_even({_N - 1} * (p / 100.0), 0) AS INTEGER) FROM (VALUES (8), (4), (2)) t(b), (VALUES {', '.join(f'({k})' for k in schemes.KEEPS)}) u(p)"""


@query("scheme_registry", f"SELECT scheme, CAST(bits_per_vec AS INTEGER) AS bits_per_vec FROM ({_REGISTRY_SQL})")
def scheme_registry(spark, sf):
    """Costs of all schemes at 1,536 numbers."""
    return spark.createDataFrame([(s.name, s.bits_per_vec) for s in _REG], "scheme string, bits_per_vec int")


@query("alias_table", f"SELECT alias, scheme FROM (VALUES {_values(KNOWN_ALIASES)}) t(alias, scheme)")
def alias_table(spark, sf):
    return spark.createDataFrame(sorted(_ALIAS.items()), "alias string, scheme string")


@query("tier_distortion", f"SELECT CAST(bits AS INTEGER) AS bits, round(pi() ** 2 * w * w / 12, 12) AS distortion "
    f"FROM (VALUES (0, 1.0), (2, 1.0 / 4), (4, 1.0 / 16), (8, 1.0 / 256), (16, 2.0 ** -10), (32, 2.0 ** -23)) t(bits, w)")
def tier_distortion(spark, sf):
    return spark.createDataFrame([(b, round(allocation.distortion(b, TOPS[0]), 12)) for b in codecs.TIERS], "bits int, distortion double")
