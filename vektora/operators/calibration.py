"""Statistics of angles over a corpus, as one aggregation per grouping."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vektora.functions import kernels
from vektora.functions.vectors import doubles, log_sensitivities, to_angles


@dataclass(frozen=True)
class Calibration:
    """One group's statistics on the driver: as many numbers as there are angles."""

    means: list[float]
    sens: list[float]
    rank: list[int]


def angles_of(vectors: DataFrame, v: str, dim: int, *keep: str) -> DataFrame:
    return vectors.select(*keep, to_angles(doubles(F.col(v)), dim).alias("angles"))


def long_angles(vectors: DataFrame, v: str, dim: int, *keep: str) -> DataFrame:
    """(keep..., pos, angle, cum): one row per angle with its log-sensitivity."""
    a = angles_of(vectors, v, dim, *keep)
    return a.select(*keep, F.posexplode(F.arrays_zip("angles", log_sensitivities(F.col("angles")).alias("cum"))).alias("pos", "z")).select(*keep, "pos", F.col("z.angles").alias("angle"), F.col("z.cum").alias("cum"))


#: Groups of one task whose sums are held before they are handed on.
HELD = 4096
#: Squares are summed about this, the middle of most angles, to keep their digits.
CENTRE = np.pi / 2


def partial_sums(vectors: DataFrame, v: str, dim: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., pos, n, s, q, c): numbers, sums of angles less CENTRE, of their squares and of log-sensitivities.

    Each task adds up whole batches and hands on one row per group, which then is spread over the
    positions. Null vectors are left out."""
    rows = vectors.filter(F.col(v).isNotNull()).select(F.struct(*(F.col(x) for x in by)).alias("k") if by else F.lit(0).alias("k"), doubles(F.col(v)).alias("v"))
    rows = rows.select(F.to_json("k").alias("j") if by else F.lit("").alias("j"), "v")

    def run(batches):
        import pyarrow as pa

        held: dict = {}

        def out():
            keys = list(held)
            sums = np.array([held[x] for x in keys])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sums[:, 0, 0].astype(np.int64)), *(kernels.lists(sums[:, i]) for i in (1, 2, 3))], names=["j", "n", "s", "q", "c"])

        for t in batches:
            if not t.num_rows:
                continue
            key = t.column("j").dictionary_encode()
            code, names = key.indices.to_numpy(), key.dictionary.to_pylist()
            a = kernels.to_angles(kernels.matrix(t.column("v")))
            c, a = kernels.log_sensitivities(a), a - CENTRE
            for i, name in enumerate(names):
                m = code == i
                new = np.stack([np.full(dim - 1, float(m.sum())), a[m].sum(axis=0), (a[m] ** 2).sum(axis=0), c[m].sum(axis=0)])
                held[name] = held[name] + new if name in held else new
            if len(held) > HELD:
                yield out()
        if held:
            yield out()

    sums = rows.mapInArrow(run, "j string, n bigint, s array<double>, q array<double>, c array<double>")
    each = sums.select("j", "n", F.posexplode(F.arrays_zip("s", "q", "c")).alias("pos", "z")).groupBy("j", "pos").agg(F.sum("n").alias("n"), *(F.sum(f"z.{x}").alias(x) for x in ("s", "q", "c")))
    if not by:
        return each.drop("j")
    schema = ", ".join(f"`{x}` {vectors.schema[x].dataType.simpleString()}" for x in by)
    return each.withColumn("k", F.from_json("j", schema)).select(*(F.col(f"k.`{x}`").alias(x) for x in by), "pos", "n", "s", "q", "c")


def angle_statistics(vectors: DataFrame, v: str, dim: int, by: Sequence[str] = (), chunk: str | None = None, backend: str = "arrow") -> DataFrame:
    """(by..., pos, mean_angle, std_angle, sens, rank) of every angle.

    sens is exp of the mean log-sensitivity, at most 1; equal ones rank by position. With `chunk` the
    log-sensitivities of chunks count alike, however many rows a chunk has. The windows run over the
    aggregated rows only. backend "columns" says the same with one row per angle, as a check."""
    if backend == "arrow":
        z = partial_sums(vectors, v, dim, [*by, *([chunk] if chunk else [])])
        m = F.sum("s") / F.sum("n")
        std = F.sqrt(F.greatest(F.sum("q") / F.sum("n") - m * m, F.lit(0.0)))
        mean = F.avg(F.col("c") / F.col("n")) if chunk else F.sum("c") / F.sum("n")
        base = z.groupBy(*by, "pos").agg((m + CENTRE).alias("mean_angle"), std.alias("std_angle"), mean.alias("m"))
    else:
        z = long_angles(vectors, v, dim, *by, *([chunk] if chunk else []))
        base = z.groupBy(*by, "pos").agg(F.avg("angle").alias("mean_angle"), F.stddev_pop("angle").alias("std_angle"), F.avg("cum").alias("m"))
        if chunk:
            means = z.groupBy(*by, chunk, "pos").agg(F.avg("cum").alias("m")).groupBy(*by, "pos").agg(F.avg("m").alias("m"))
            base = base.drop("m").join(means, [*by, "pos"])
    all_ = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    out = base.withColumn("sens", F.exp(F.col("m") - F.max("m").over(all_)))
    return out.withColumn("rank", F.row_number().over(all_.orderBy(F.desc(F.round("sens", 12)), "pos")) - 1).drop("m")


def collect(stats: DataFrame) -> Calibration:
    """The statistics of one group (dim - 1 rows) for literals in codecs."""
    rows = sorted(stats.select("pos", "mean_angle", "sens", "rank").collect())
    return Calibration([r["mean_angle"] for r in rows], [r["sens"] for r in rows], [r["rank"] for r in rows])
