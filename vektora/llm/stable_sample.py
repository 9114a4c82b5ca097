"""Samples by permanent random numbers.

At first sight each identifier gets a uniform value, which is written to a register and never
changes; later loads only insert identifiers that the register lacks. A sample is all identifiers
whose value lies under a threshold, and thresholds may rise but never fall, so whoever has been
drawn stays drawn. The value is a hash of seed, kind and identifier: row order, repeated rows, file
layout and reruns change nothing, and two registers of the same seed agree.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vektora.session import _fs

#: 52 bits of the digest fill a double's fraction exactly.
DIGITS = 13


def uniform(kind: Column, ident: Column, seed: str) -> Column:
    """In [0, 1): the first 52 bits of the MD5 digest of seed, kind and identifier."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), kind, ident).cast("binary"))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("bigint") / F.lit(float(16**DIGITS))


class Register:
    """Identifiers with their permanent values, in a folder of parquet batches that are only added to."""

    def __init__(self, spark: SparkSession, path: str, seed: str = "vektora"):
        self.spark, self.path, self.seed = spark, path.rstrip("/"), seed

    def _exists(self, path: str) -> bool:
        fs, p = _fs(self.spark, path)
        return fs.exists(p)

    def numbers(self) -> DataFrame:
        """(kind, id, u, batch) of all identifiers seen so far."""
        schema = "kind string, id string, u double, batch int"
        if not self._exists(f"{self.path}/numbers"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/numbers")

    def insert(self, ids: DataFrame, batch: int) -> None:
        """Give values to the (kind, id) of `ids` that have none yet. Nulls are left out; repeats count once.

        A batch is a folder that is written as a whole, so that a batch tried again replaces itself."""
        seen = self.numbers().filter(F.col("batch") != batch)
        new = ids.filter("kind is not null and id is not null").select("kind", "id").distinct().join(seen.select("kind", "id"), ["kind", "id"], "left_anti")
        new.withColumn("u", uniform(F.col("kind"), F.col("id"), self.seed)).write.mode("overwrite").parquet(f"{self.path}/numbers/batch={batch}")

    def select(self, threshold: float) -> DataFrame:
        """(kind, id, u) with u under the threshold, which must not be lower than any used before."""
        if not 0 <= threshold <= 1:
            raise ValueError("the threshold must lie in [0, 1]")
        at = f"{self.path}/threshold.json"
        if self._exists(at):
            before = json.loads("".join(r[0] for r in self.spark.read.text(at).collect()))["threshold"]
            if threshold < before:
                raise ValueError(f"the threshold was {before} before and can't fall to {threshold}")
        fs, p = _fs(self.spark, at)
        out = fs.create(p, True)
        out.write(bytearray(json.dumps({"threshold": threshold}).encode()))
        out.close()
        return self.numbers().filter(F.col("u") < threshold).select("kind", "id", "u")
