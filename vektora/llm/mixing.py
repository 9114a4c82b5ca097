"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies. The expected copies are added up along
the source's documents, one random offset per source is added, and a document is given out once for
each whole number that its stretch of the sum crosses. Documents are lined up by size, so that the
drawn ones have nearly the expected share of the tokens, too, and once more by a hash, which for small
sources has more different outcomes. Of these lines and some offsets, evenly spaced from a random one
on, each source takes those whose documents come nearest to the expected tokens.

Sums are whole billionths and thus exact. The line of a source is cut into buckets (size class and
hash), whose sums are added up first, so that no task has to walk along a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vektora.session import materialize

UNIT = 1_000_000_000
#: Offsets that each source chooses from.
OFFSETS = 64


def plan(totals: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, int]:
    """Expected copies per document of each source, in billionths.

    totals: tokens per source; targets: share and most repeats. Without `total` the mixture is as large
    as it can be with every source that has tokens at its share. With it, sources that can't reach their
    share are used as often as allowed and the others make up for them, in proportion to their shares,
    as far as they can. Sources without tokens, share or repeats get 0."""
    live = {s: (w, r) for s, (w, r) in targets.items() if w and w > 0 and r and r > 0 and totals.get(s, 0) > 0}
    if not live:
        return dict.fromkeys(targets, 0)
    if total is None:
        total = min(r * totals[s] / w for s, (w, r) in live.items()) * sum(w for w, _ in live.values())
    given: dict[str, float] = {}
    while len(given) < len(live):
        left = {s: w for s, (w, _) in live.items() if s not in given}
        rest, weights = max(0.0, total - sum(given.values())), sum(left.values())
        full = {s: live[s][1] * totals[s] for s, w in left.items() if rest * w / weights >= live[s][1] * totals[s]}
        given |= full or {s: rest * w / weights for s, w in left.items()}
    return {s: min(live[s][1] * UNIT, math.floor(given[s] / totals[s] * UNIT)) if s in live else 0 for s in targets}


def copies(sized: DataFrame, key: str, source: str, size: str, targets: DataFrame, total: float | None = None, seed: str = "vektora") -> DataFrame:
    """(key, source, size, copies) of every record of a source in `targets` (source, target_share, max_repeats).

    0 <= copies <= max_repeats. Records of other sources, of null ones included, are left out; a null
    size counts as 0; repeated records are drawn each for itself. targets has one row per source and
    is read by the driver; so are the totals of those sources."""
    t = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.select("source", "target_share", "max_repeats").collect()}
    known = targets.select(F.col("source").alias("_s")).distinct()
    d = sized.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("_s"), F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("bigint").alias("size")).join(known, "_s")
    totals = {r["_s"]: r["n"] for r in d.groupBy("_s").agg(F.sum("size").alias("n")).collect()}
    expected = sized.sparkSession.createDataFrame([(s, e) for s, e in plan(totals, t, total).items()] or [("", 0)], "_s string, e bigint")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.col("_s"))), 1, 8), 16, 10).cast("bigint") % UNIT
    h = F.xxhash64("key", F.lit(seed))
    d = d.join(expected, "_s").withColumns({"h": h, "b": F.shiftright(h, 56).cast("int")})

    def lined(rows: DataFrame, name: str, c: Column) -> DataFrame:
        """`rows` with the sum of expected copies up to each, in the order of c and the hash."""
        rows = rows.withColumn("c", c)
        line = Window.partitionBy("_s").orderBy("c", "b").rowsBetween(Window.unboundedPreceding, -1)
        sums = rows.groupBy("_s", "c", "b").agg(F.sum("e").alias("sum")).withColumn("before", F.coalesce(F.sum("sum").over(line), F.lit(0)) + offset).drop("sum")
        step = Window.partitionBy("_s", "c", "b").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumn("upto", F.sum("e").over(step)).join(sums, ["_s", "c", "b"]).withColumn(name, F.col("upto") + F.col("before")).drop("upto", "before", "c")

    at = lined(lined(d, "l0", F.floor(F.log2(F.col("size") + 1) * 64).cast("int")), "l1", F.lit(0))
    at = materialize(at.select("key", "_s", "size", "e", "l0", "l1"), "line").df
    crossed = lambda line, o: F.expr(f"({line} + {o}) div {UNIT} - ({line} - e + {o}) div {UNIT}")
    moves = [j * UNIT // OFFSETS for j in range(OFFSETS)]
    best: dict[str, tuple] = {}
    for line in ("l0", "l1"):  # one row per source: what each offset would give, and what is expected
        tried = at.groupBy("_s").agg((F.sum("size") * F.max("e") / F.lit(UNIT)).cast("double").alias("want"), *(F.sum(F.col("size") * crossed(line, o)).alias(f"t{j}") for j, o in enumerate(moves)))
        for r in tried.collect():
            new = min((abs(r[f"t{j}"] - r["want"]), line, o) for j, o in enumerate(moves))
            best[r["_s"]] = min(best.get(r["_s"], new), new)
    chosen = sized.sparkSession.createDataFrame([(s, line, o) for s, (_, line, o) in best.items()] or [("", "", 0)], "_s string, line string, o bigint")
    out = at.join(F.broadcast(chosen), "_s").withColumn("l", F.when(F.col("line") == "l0", F.col("l0")).otherwise(F.col("l1")))  # one row per target source
    return out.select(F.col("key").alias(key), F.col("_s").alias(source), F.col("size").alias(size), crossed("l", "o").cast("int").alias("copies"))


def shares(drawn: DataFrame, source: str, size: str, targets: DataFrame) -> DataFrame:
    """Per target source: target_share, actual_share, max_repeats, repeats (the most of any record), records, tokens, mixed_tokens, capped.

    capped: the source is used as often as it may be."""
    got = drawn.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("records"), F.sum(size).alias("tokens"), F.sum(F.col(size) * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("repeats"))
    got = materialize(got, "shares").df  # one row per target source
    total = got.agg(F.sum("mixed_tokens").alias("n")).first()["n"] or 0
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    actual = F.coalesce(F.col("mixed_tokens"), F.lit(0)) / F.lit(float(total)) if total else F.lit(0.0)
    return targets.join(got, "source", "left").select("source", "target_share", actual.alias("actual_share"), "max_repeats", z("repeats"), z("records"), z("tokens"), z("mixed_tokens"), F.coalesce((F.col("tokens") > 0) & (F.col("mixed_tokens") == F.col("tokens") * F.col("max_repeats")), F.lit(False)).alias("capped"))
