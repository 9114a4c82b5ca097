"""Growing results equal those of one run, also after a replay."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vektora.operators import calibration, scoring
from vektora.streaming import incremental as inc

SCHEMA = "id bigint, v array<double>"


@pytest.fixture
def arriving(spark, tmp_path):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(60, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], SCHEMA)
    df.repartition(3, "id").write.parquet(f"{tmp_path}/in")
    return df


def test_statistics_and_topk(spark, tmp_path, arriving):
    state = inc.State(spark, f"{tmp_path}/a", {"dim": 8})
    step = inc.statistics_step(state, 8)
    inc.run(spark, f"{tmp_path}/in", SCHEMA, step, f"{tmp_path}/ca")
    got = {r.pos: (r.mean_angle, r.sens) for r in inc.finished_statistics(state).collect()}
    want = {r.pos: (r.mean_angle, r.sens) for r in calibration.angle_statistics(arriving, "v", 8).collect()}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)

    queries = arriving.filter("id < 4")
    docs = lambda b: b.select(F.lit("f").alias("scheme"), "id", "v")
    top = inc.State(spark, f"{tmp_path}/b", {"k": 5})
    inc.run(spark, f"{tmp_path}/in", SCHEMA, inc.topk_step(top, queries, 5, docs), f"{tmp_path}/cb")
    plain = sorted((r.query_id, r.rank, r.doc_id) for r in scoring.topk(docs(arriving), queries, 5).collect())
    assert sorted((r.query_id, r.rank, r.doc_id) for r in top.read().collect()) == plain


def test_replay_and_guard(spark, tmp_path, arriving):
    state = inc.State(spark, f"{tmp_path}/s", {"dim": 8})
    step = inc.statistics_step(state, 8)
    step(arriving.filter("id < 30"), 0)
    step(arriving.filter("id >= 30"), 1)
    first = sorted(map(tuple, inc.finished_statistics(state).collect()))
    step(arriving.filter("id >= 30"), 1)  # the same batch again
    assert np.allclose(sorted(map(tuple, inc.finished_statistics(state).collect())), first)
    inc.State(spark, f"{tmp_path}/s", {"dim": 8})
    with pytest.raises(ValueError):
        inc.State(spark, f"{tmp_path}/s", {"dim": 9})
