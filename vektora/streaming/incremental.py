"""Statistics and top-k that grow with arriving files, with durable state.

State is a folder of versions, one per batch id, each written whole; a batch that is replayed
overwrites its own version from its predecessor, so nothing counts twice. The settings that a state
was made with are kept beside it, and other settings are refused.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vektora.operators.calibration import CENTRE, Calibration, partial_sums
from vektora.operators.schemes import Scheme
from vektora.operators.scoring import merged, topk, topk_schemes
from vektora.session import _fs


class State:
    """Versions of a table in a folder."""

    def __init__(self, spark: SparkSession, path: str, settings: dict):
        self.spark, self.path = spark, path.rstrip("/")
        fs, p = _fs(spark, f"{self.path}/settings.json")
        text = json.dumps(settings, sort_keys=True)
        if fs.exists(p):
            before = "".join(r[0] for r in spark.read.text(str(p)).collect())
            if before != text:
                raise ValueError(f"the state at {path} was made with other settings: {before}")
        else:
            out = fs.create(p, False)
            out.write(bytearray(text.encode()))
            out.close()

    def versions(self) -> list[int]:
        fs, p = _fs(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [int(n[1:]) for n in names if n.startswith("v") and _fs(self.spark, f"{self.path}/{n}/_SUCCESS")[0].exists(_fs(self.spark, f"{self.path}/{n}/_SUCCESS")[1])]
        return sorted(done)

    def before(self, batch: int) -> DataFrame | None:
        older = [v for v in self.versions() if v < batch]
        return self.spark.read.parquet(f"{self.path}/v{older[-1]}") if older else None

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v{batch}")
        for v in self.versions()[:-2]:  # the last but one is kept for a replay
            fs, p = _fs(self.spark, f"{self.path}/v{v}")
            fs.delete(p, True)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.versions()[-1]}")


def statistics_step(state: State, dim: int) -> Callable[[DataFrame, int], None]:
    """foreachBatch: sums of angles, squares and log-sensitivities per position."""

    def step(batch: DataFrame, n: int) -> None:
        new, old = partial_sums(batch, "v", dim), state.before(n)
        rows = new if old is None else new.unionByName(old)
        state.write(rows.groupBy("pos").agg(*(F.sum(x).alias(x) for x in ("n", "s", "q", "c"))), n)

    return step


def finished_statistics(state: State, rank: bool = False) -> DataFrame:
    """(pos, mean_angle, sens) of all batches so far, with `rank` also the place by falling sensitivity."""
    from pyspark.sql import Window

    rows = state.read().select("pos", (F.col("s") / F.col("n") + CENTRE).alias("mean_angle"), (F.col("c") / F.col("n")).alias("m"))
    all_ = Window.partitionBy(F.lit(0))  # as many rows as there are angles
    out = rows.withColumn("sens", F.exp(F.col("m") - F.max("m").over(all_))).drop("m")
    return out.withColumn("rank", F.row_number().over(all_.orderBy(F.desc(F.round("sens", 12)), "pos")) - 1) if rank else out


def topk_step(state: State, queries: DataFrame, k: int, decode: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """foreachBatch: the running top-k per scheme and query; `decode` gives (scheme, id, v) of a batch."""

    def step(batch: DataFrame, n: int) -> None:
        new, old = topk(decode(batch), queries, k), state.before(n)
        state.write(new if old is None else merged(old, new, k), n)

    return step


def schemes_step(state: State, queries: DataFrame, k: int, dim: int, schemes: Sequence[Scheme], stats: Calibration | None) -> Callable[[DataFrame, int], None]:
    """foreachBatch: the running top-k of all schemes, whose batches (id, v) are decoded where they are scored."""

    def step(batch: DataFrame, n: int) -> None:
        new, old = topk_schemes(batch, "id", "v", dim, schemes, stats, queries, k), state.before(n)
        state.write(new if old is None else merged(old, new, k), n)

    return step


def run_super_batches(batches: Sequence[Sequence[str]], read: Callable[[Sequence[str]], DataFrame], step: Callable[[DataFrame, int], None], state: State) -> int:
    """Work through super-batches of chunks (by `readers.super_batches`) in order and give the number done.

    A batch whose version of the state exists is skipped, so that a run that was broken off goes on
    behind the last whole one. The batches must be those the state was begun with."""
    have, done = max(state.versions(), default=-1), 0
    for n, paths in enumerate(batches):
        if n > have:
            step(read(paths), n)
            done += 1
    return done


def run(spark: SparkSession, path: str, schema, step: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int = 1, glob: str = "*.parquet") -> None:
    """Work through all files now in a folder, in batches; a later run goes on where this one ended."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", glob).parquet(path)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
