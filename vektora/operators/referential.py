"""References to records that do not exist.

Child rows are grouped by the null mask of their composite key; each mask is anti-joined on its
non-null columns under a declared match rule, optionally as of a time on the child row.

Match rules for keys with nulls, as in the SQL standard:

* ``simple``   any null: the reference holds, nothing is looked up
* ``partial``  the non-null columns must be found; all null: holds
* ``full``     all null: holds; some but not all null: an orphan without a look-up

or a rule for each column: ``holds``, a null there makes the reference hold; ``unmatched``, a null
there can't be found, so that the row is an orphan unless another column makes it hold; ``ignored``,
the other columns are looked up without it (none left: holds).

Null times: a child row without a time finds nothing (its record can't be present); a parent row
without a start is never present; without an end it stays.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MATCH = ("simple", "partial", "full")
RULES = ("holds", "unmatched", "ignored")
#: A key with more than this share of the rows counts as hot, so that there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 200
SALTS = 32


def presence(parents: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """The disjoint spans [since, until) in which each key is present, ends open where `until` is null.

    Repeated rows and reloads are collapsed by partial aggregation before the one window per key."""
    far = F.lit("9999-12-31 00:00:00").cast(parents.schema[start].dataType)
    spans = (
        parents.filter(F.col(start).isNotNull())
        .select(*keys, F.col(start).alias("_s"), F.coalesce(F.col(end).cast(parents.schema[start].dataType), far).alias("_e"))
        .filter("_s < _e")
        .groupBy(*keys, "_e")
        .agg(F.min("_s").alias("_s"))
        .groupBy(*keys, "_s")
        .agg(F.max("_e").alias("_e"))
    )
    by = Window.partitionBy(*keys).orderBy("_s")
    before = F.max("_e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    return (
        spans.withColumn("_new", F.when(before >= F.col("_s"), 0).otherwise(1))
        .withColumn("_n", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_n")
        .agg(F.min("_s").alias("since"), F.max("_e").alias("until"))
        .withColumn("until", F.when(F.col("until") < far, F.col("until")))
        .drop("_n")
    )


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold more than `share` of the rows: at most 1/share rows, so safe to broadcast."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    total = df.agg((F.count(F.lit(1)) * F.lit(share)).alias("_t"))
    return counts.join(F.broadcast(total), F.col("_c") > F.col("_t")).select(*keys)


def salted_anti_join(left: DataFrame, right: DataFrame, keys: Sequence[str], holds: Column | None = None, salt_by: Sequence[str] = (), salts: int = SALTS) -> DataFrame:
    """left ANTI right on `keys` and `holds`, rows of hot left keys being dealt over `salts` tasks.

    Only the hot keys' right rows are repeated, once per salt. Names of both sides must differ but for `keys`."""
    hot = hot_keys(left, keys)
    same = reduce(lambda a, b: a & b, (F.col(f"l.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys))
    mark = lambda df: df.alias("l").join(F.broadcast(hot.withColumn("_hot", F.lit(True)).alias("h")), same, "left").select("l.*", F.coalesce("_hot", F.lit(False)).alias("_hot"))
    a = mark(left).withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*(salt_by or left.columns)), F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    b = mark(right).withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    on = reduce(lambda x, y: x & y, (F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*keys, "_salt")))
    return a.alias("a").join(b.alias("b"), on & holds if holds is not None else on, "left_anti").drop("_salt")


def orphans(
    children: DataFrame,
    parents: DataFrame,
    columns: Mapping[str, str],
    match: str | Mapping[str, str] = "simple",
    at: str | None = None,
    start: str | None = None,
    end: str | None = None,
    salt_by: Sequence[str] = (),
) -> DataFrame:
    """Rows of `children` whose reference fails, with all their columns.

    columns: child column -> parent column of the composite key. at/start/end: a parent counts only
    while start <= at < end. Repeated child rows stay repeated; an empty parent table makes every
    looked-up reference an orphan; parents with a null in a looked-up column can't be found through it.
    Other columns of either side may have any names."""
    if isinstance(match, str) and match not in MATCH or isinstance(match, Mapping) and (set(match) != set(columns) or not set(match.values()) <= set(RULES)):
        raise ValueError(f"match must be one of {MATCH}, or one of {RULES} for each column")
    spark, kids = children.sparkSession, [f"_k{i}" for i in range(len(columns))]
    given = children.columns
    c = children.select(F.struct(*(F.col(f"`{x}`") for x in given)).alias("_row"), *(F.col(f"`{x}`").alias(k) for x, k in zip(columns, kids, strict=True)), (F.col(f"`{at}`") if at else F.lit(None).cast("timestamp")).alias("_at"), F.xxhash64(*(F.col(f"`{x}`") for x in (salt_by or given) if children.schema[x].dataType.typeName() not in ("map", "variant"))).alias("_h"))
    p = parents.select(*(F.col(f"`{y}`").alias(k) for y, k in zip(columns.values(), kids, strict=True)), *((F.col(f"`{start}`").alias("_start"), F.col(f"`{end}`").alias("_end")) if at else ()))
    out = []
    for mask in product((False, True), repeat=len(kids)):  # True: null
        rows = c.filter(reduce(lambda a, b: a & b, (F.col(k).isNull() if m else F.col(k).isNotNull() for k, m in zip(kids, mask, strict=True))))
        keys = [k for k, m in zip(kids, mask, strict=True) if not m]
        verdict = _verdict(match, [x for x, m in zip(columns, mask, strict=True) if m], len(keys))
        if verdict == "holds":
            continue
        if verdict == "unmatched":
            out.append(rows)
            continue
        held = p.filter(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)))
        if at:
            spans = presence(held, keys, "_start", "_end")
            holds = (F.col("since") <= F.col("_at")) & (F.col("until").isNull() | (F.col("_at") < F.col("until")))
        else:
            spans, holds = held.select(*keys).distinct(), None
        out.append(salted_anti_join(rows, spans, keys, holds, salt_by=("_h",)))
    if not out:
        return spark.createDataFrame([], children.schema)
    return reduce(DataFrame.unionByName, (x.select("_row.*") for x in out))


def _verdict(match: str | Mapping[str, str], null: list[str], left: int) -> str:
    """What the match rule says of the rows with nulls in these columns: holds, unmatched or (look the rest up) ignored."""
    if not null:
        return "ignored"
    if isinstance(match, str):
        return "holds" if match == "simple" or not left else {"partial": "ignored", "full": "unmatched"}[match]
    rules = {match[c] for c in null}
    return "holds" if "holds" in rules else "unmatched" if "unmatched" in rules else "ignored" if left else "holds"


def orphan_report(found: DataFrame, by: Sequence[str], time: str) -> DataFrame:
    """Orphans counted per `by` and calendar month of `time` (UTC, YYYY-MM; null stays null)."""
    return found.groupBy(*by, F.date_format(time, "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("orphans"))
