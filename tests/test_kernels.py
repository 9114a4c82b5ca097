"""The codecs on matrices against the Column expressions, and stored codes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vektora.functions import kernels
from vektora.functions.vectors import from_angles, log_sensitivities, ranges, to_angles
from vektora.operators import calibration, schemes, scoring, stored

DIM = 24


def vectors(n=40, dim=DIM, seed=1):
    m = np.random.default_rng(seed).normal(size=(n, dim))
    m[0, 3:] = 0
    m[1] = -np.abs(m[1])
    m[2] = 0
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def frame(spark, m):
    return spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(m)], "id bigint, part int, v array<double>")


def test_angles_both_ways(spark):
    m = vectors()
    a = kernels.to_angles(m)
    rows = frame(spark, m).select("id", to_angles(F.col("v"), DIM).alias("a")).select("id", "a", from_angles(F.col("a")).alias("r"), log_sensitivities(F.col("a")).alias("s")).orderBy("id").collect()
    assert np.allclose([r.a for r in rows], a, atol=1e-9)
    assert np.allclose([r.r for r in rows], kernels.from_angles(a), atol=1e-9)
    assert np.allclose([r.s for r in rows], kernels.log_sensitivities(a), atol=1e-9)


def test_every_scheme_decodes_alike(spark):
    df = frame(spark, vectors())
    stats = calibration.collect(calibration.angle_statistics(df, "v", DIM))
    every = schemes.registry(DIM, stats, (60, 200, 400))
    got = {(r.scheme, r.id): r.v for r in schemes.decode_all(df, "id", "v", DIM, every, stats).collect()}
    want = {(r.scheme, r.id): r.v for r in schemes.decode_all(df, "id", "v", DIM, every, stats, "columns").collect()}
    assert set(got) == set(want) and len(got) == 40 * len(every)
    assert all(np.allclose(got[k], want[k], atol=1e-9) for k in got)


@pytest.mark.parametrize("by, chunk", [([], None), (["part"], None), ([], "part")])
def test_statistics_alike(spark, by, chunk):
    df = frame(spark, vectors()).unionByName(spark.createDataFrame([(99, 1, None)], "id bigint, part int, v array<double>"))
    key = [*by, "pos"]
    got, want = ({tuple(r[c] for c in key): r for r in calibration.angle_statistics(df.filter("v is not null") if b == "columns" else df, "v", DIM, by, chunk, b).collect()} for b in ("arrow", "columns"))
    assert set(got) == set(want)
    for k in got:
        assert got[k]["rank"] == want[k]["rank"] and np.allclose([got[k][c] for c in ("mean_angle", "std_angle", "sens")], [want[k][c] for c in ("mean_angle", "std_angle", "sens")], atol=1e-7)


def test_many_numbers(spark):
    """At 1,536 numbers, where the expressions take too long: angles come back as vectors, codes within half a bin."""
    m = vectors(8, 1536)
    a = kernels.to_angles(m[3:])
    assert np.abs(kernels.from_angles(a) - m[3:]).max() < 1e-6
    df = frame(spark, m[3:])
    stats = calibration.collect(calibration.angle_statistics(df, "v", 1536))
    assert len(stats.means) == 1535 and stats.rank[0] == 0
    chosen, missing = schemes.select(schemes.registry(1536, stats), ["cart_int8", "angle_int8_uniform", "none"])
    assert missing == ["none"] and [s.name for s in chosen] == ["cart_int8", "angle_int8_uniform"]
    err = schemes.decode_all(df, "id", "v", 1536, chosen, stats).join(df.select("id", F.col("v").alias("w")), "id").select(F.sqrt(F.aggregate(F.zip_with("v", "w", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))).collect()
    assert max(r[0] for r in err[::1]) < 1.5


def test_a_scheme_from_outside(spark):
    df = frame(spark, vectors())
    mine = schemes.Scheme("signs", "own", DIM, decode=lambda v, a: np.sign(v) / np.sqrt(v.shape[1]))
    got = schemes.decode_all(df, "id", "v", DIM, [mine], None).filter("id = 5").first().v
    assert np.allclose(np.abs(got), 1 / np.sqrt(DIM))
    r = scoring.topk_schemes(df, "id", "v", DIM, [mine, schemes.Scheme("float32", "float", 32 * DIM)], None, df.select("id", "v").filter("id > 36"), 5)
    assert r.count() == 2 * 3 * 5


def test_running_top_k(spark, monkeypatch):
    """Blocks of queries, batches of documents and ties by id."""
    rng = np.random.default_rng(2)
    m, q = np.round(rng.normal(size=(300, 4)), 1), np.round(rng.normal(size=(23, 4)), 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id bigint, v array<double>").repartition(5)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(99, None)], "id bigint, v array<double>")
    s = np.round(q @ m.T, 9)
    want = sorted((i, int(d), p + 1) for i in range(len(q)) for p, d in enumerate(np.lexsort((np.arange(300), -s[i]))[:7]))
    for block in (4096, 5):
        monkeypatch.setattr(scoring, "BLOCK", block)
        for r in (scoring.topk(df.withColumn("scheme", F.lit("f")), asked, 7), scoring.topk_schemes(df, "id", "v", 4, [schemes.Scheme("f", "float", 128)], None, asked, 7)):
            assert sorted((x.query_id, x.doc_id, x["rank"]) for x in r.collect()) == want


def test_stored_codes(spark):
    m = vectors()
    df = frame(spark, m)
    tiers = [codec for _, codec in zip(range(DIM - 1), [0, 2, 4, 8, 16, 32] * 9)]
    means = [1.5] * (DIM - 1)
    coded = stored.encode(df, "id", "v", DIM, tiers)
    one = coded.filter("id = 7").first()
    assert [len(one[c]) for c in stored.COLUMN.values()] == [tiers.count(b) for b in stored.COLUMN]
    plain = {r.id: r.v for r in stored.decode(coded, "id", DIM, tiers, means).collect()}
    tops = np.array(ranges(DIM))
    want = kernels.from_angles(kernels.tiered(kernels.to_angles(m), tops, tiers, np.array(means)))
    assert all(np.allclose(plain[i], want[i], atol=1e-6) for i in range(len(m)))
    packed = stored.pack(df, "id", "v", DIM, tiers)
    assert {len(r.packed) for r in packed.collect()} == {-(-stored.bits_per_vector(tiers) // 8)}
    again = {r.id: r.v for r in stored.unpack(packed, "id", DIM, tiers, means).collect()}
    assert all(np.allclose(again[i], plain[i], atol=1e-9) for i in plain)
    assert stored.encode(df.limit(0), "id", "v", DIM, tiers).count() == 0
