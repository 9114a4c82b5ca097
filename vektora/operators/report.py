"""Tables over results: macro-averages, baselines, ablations, trade-offs, frontiers, tier histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FULL_SIZE = 5_416_568


def ratio(bits: Column, base: Column | float) -> Column:
    """base / bits, infinite for 0 bits."""
    base = base if isinstance(base, Column) else F.lit(float(base))
    return F.when(bits == 0, F.lit(float("inf"))).otherwise(base / F.nullif(bits, F.lit(0)))


def with_baseline(results: DataFrame, baseline: str, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds compression_ratio and retained (share of the baseline's metric, null without a baseline).

    A group has one baseline row."""
    base = results.filter(F.col("scheme") == baseline).select(*by, F.col("bits_per_vec").alias("_bits"), F.col(metric).alias("_metric"))
    joined = results.join(base, list(by), "left") if by else results.crossJoin(F.broadcast(base))
    return joined.withColumn("compression_ratio", ratio(F.col("bits_per_vec"), F.col("_bits"))).withColumn("retained", F.col(metric) / F.nullif(F.col("_metric"), F.lit(0.0))).drop("_bits", "_metric")


def macro(results: DataFrame, metrics: Sequence[str], by: str = "scheme") -> DataFrame:
    """Means over subsets, with n_subsets; bits and ratio of the first subset by name."""
    first = [F.min_by(c, "subset").alias(c) for c in ("bits_per_vec", "compression_ratio") if c in results.columns]
    return results.groupBy(by).agg(*first, *(F.avg(m).alias(m) for m in metrics), F.count(F.lit(1)).alias("n_subsets"))


def macro_rollup(results: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Per scheme and subset, and (subset null) per scheme over all subsets."""
    return results.rollup("scheme", "subset").agg(*(F.avg(m).alias(m) for m in metrics), F.count(F.lit(1)).alias("n")).filter("scheme is not null")


def ablation(results: DataFrame, order: str, metric: str, baseline: float, float_bits: int) -> DataFrame:
    """delta to the row before (the first: to the baseline), ratio to the first row's bits and to float32's."""
    w = Window.partitionBy(F.lit(0)).orderBy(order)  # a handful of rows
    return results.select(
        "*",
        (F.col(metric) - F.coalesce(F.lag(metric).over(w), F.lit(baseline))).alias("delta"),
        ratio(F.col("bits_per_vec"), F.first("bits_per_vec").over(w).cast("double")).alias("ratio_first"),
        ratio(F.col("bits_per_vec"), float_bits).alias("ratio_float32"),
    )


def percent_of(label: Column) -> Column:
    """The number before a percent sign or "pct" in a label, null if there is none."""
    return F.nullif(F.regexp_extract(label, r"(\d+)(?:%|pct)", 1), F.lit("")).cast("int")


def tradeoff(positional: DataFrame, jacobian: DataFrame, metric: str, dim: int, full_size: int = FULL_SIZE) -> DataFrame:
    """Positional and Jacobian clips side by side by their percentage, with the megabytes saved at full size."""
    side = lambda df, c: df.select(percent_of(F.col("scheme")).alias("clip_pct"), F.col("bits_per_vec").alias(f"bits_{c}"), F.col(metric).alias(f"{metric}_{c}"))
    both = side(positional, "pos").join(side(jacobian, "jac"), "clip_pct")
    return both.select(
        "clip_pct",
        F.col("bits_jac").alias("bits_per_vec"),
        ratio(F.col("bits_jac"), 32 * dim).alias("compression_ratio"),
        f"{metric}_pos",
        f"{metric}_jac",
        (F.col(f"{metric}_jac") - F.col(f"{metric}_pos")).alias("delta"),
        ((4 * dim - F.col("bits_jac") / 8) * full_size / 1e6).alias("mb_saved"),
    )


def pareto(results: DataFrame, metric: str) -> DataFrame:
    """Schemes that no other beats: none is as small and better, or smaller and as good."""
    w = Window.partitionBy(F.lit(0)).orderBy("bits_per_vec")  # as many rows as there are schemes
    before = F.max(metric).over(w.rangeBetween(Window.unboundedPreceding, -1))
    same = F.max(metric).over(Window.partitionBy("bits_per_vec"))
    return results.withColumn("_b", before).withColumn("_s", same).filter((F.col(metric) >= F.col("_s")) & (F.col("_b").isNull() | (F.col(metric) > F.col("_b")))).drop("_b", "_s")


def tier_histogram(tiers: DataFrame) -> DataFrame:
    return tiers.groupBy("scheme", "bits").agg(F.count(F.lit(1)).alias("angles"))


def fixed_width(results: DataFrame, metrics: Sequence[str], width: int = 40) -> DataFrame:
    """One line of text per row, for a table in a file: scheme, bits, ratio where there is one, metrics."""
    times = [F.lpad(F.format_string("%.2fx", "compression_ratio"), 8, " ")] if "compression_ratio" in results.columns else []
    line = F.concat_ws(" ", F.rpad("scheme", width, " "), F.lpad(F.col("bits_per_vec").cast("string"), 8, " "), *times, *(F.lpad(F.format_string("%.4f", F.col(m)), 9, " ") for m in metrics))
    return results.select(line.alias("value"))
