"""Sessions, the shared folder for intermediate tables, and spreading of small inputs."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def get_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", name: str = "vektora") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share.

    Where the setting is absent a temporary folder is made and set if the session runs in one process
    on one machine, as in tests; on a cluster that is an error, as every executor would write its own disk."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not at and sc._jsc.sc().getCheckpointDir().isDefined():
        at = sc._jsc.sc().getCheckpointDir().get()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="vektora-")
        sc.setCheckpointDir(at)
    return at


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that `materialize` wrote."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


_own: set[str] = set()


class Stored:
    """A table written to the shared folder: `df` reads it, `drop()` deletes it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.df = spark, path, spark.read.parquet(path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the driver ends."""
    base = f"{shared_dir(spark).rstrip('/')}/vektora-{spark.sparkContext.applicationId}"
    if base not in _own:
        _own.add(base)
        atexit.register(_clean, spark, base)
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def _clean(spark: SparkSession, base: str) -> None:
    try:
        remove(spark, base)
    except Exception:
        pass  # the JVM may be gone already


def materialize(df: DataFrame, name: str = "t", compression: str = "zstd") -> Stored:
    """Write `df` once to the shared folder and read it back.

    This cuts the lineage as checkpoint() does, is computed only once, is columnar, and survives
    the loss of executors, since the files are not theirs. Vectors hardly compress: use "lz4"."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", compression).parquet(path)
    return Stored(spark, path)


def materialize_counting(df: DataFrame, name: str, what: Column | None = None) -> tuple[Stored, int]:
    """`materialize`, and how many rows (or rows for which `what` holds) were written, without another job.

    A task that runs twice may count twice, so only none and some can be told apart for certain."""
    seen = Observation()
    each = F.lit(1) if what is None else F.when(what, 1)
    stored = materialize(df.observe(seen, F.count(each).alias("n")), name)
    return stored, seen.get["n"]


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs run inside hand Python at most so many rows at a time: for rows of kilobytes, of which an executor holds whole batches beside its heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), most) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Make use of all cores where a scan has fewer splits than there are cores.

    Meant for CPU-bound stages right behind a scan; scans with enough splits are left alone. Not for
    plans that shuffle anyway."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores * 2, *keys)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle by `keys` into partitions that aren't put together again, for CPU-bound stages behind it.

    A grouping or join by the same keys needs no other shuffle."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *keys)
