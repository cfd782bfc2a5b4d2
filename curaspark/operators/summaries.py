"""Summaries across channels, roles, methods and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_std(rows: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """Mean and sample deviation of each column, as <column>_mean and <column>_std."""
    aggregates = [f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    return (rows.groupBy(*by) if by else rows.groupBy()).agg(*aggregates)


def micro(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Precision, recall and F1 from summed tp, fp and fn."""
    sums = rows.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    p = F.when(tp + fp > 0, tp / F.when(tp + fp > 0, tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / F.when(tp + fn > 0, tp + fn)).otherwise(0.0)
    return sums.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * p * r / F.when(p + r > 0, p + r)).otherwise(0.0))


def grand_total(rows: DataFrame, key: str, sums: list[Column], label: str = "Total") -> DataFrame:
    """Sums by key and over all, the latter under `label`."""
    got = rows.rollup(key).agg(F.grouping(key).alias("_all"), *sums)
    return got.withColumn(key, F.when(F.col("_all") == 1, label).otherwise(F.col(key))).drop("_all")


def lower_percentiles(rows: DataFrame, by: list[str], value: str, at: list[tuple[str, float]]) -> DataFrame:
    """For each (name, q) the value at index floor(q * (n - 1)) of the ascending values; no group is collected."""
    w = Window.partitionBy(*by)
    ranked = rows.select(*by, value, (F.row_number().over(w.orderBy(value)) - 1).alias("i"), F.count("*").over(w).alias("n"))
    picks = [F.max(F.when(F.col("i") == F.floor(F.lit(q) * (F.col("n") - 1)), F.col(value))).alias(name) for name, q in at]
    return ranked.groupBy(*by).agg(*picks)


USAGE = ["input_tokens", "cached_input_tokens", "uncached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens", "cost_usd"]


def role_usage(calls: DataFrame, by: list[str]) -> DataFrame:
    """Calls, calls without usage, totals, averages and lower-index percentiles of cost."""
    known = [c for c in USAGE if c in calls.columns]
    filled = calls.select(*by, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in known))
    missing = F.count_if((F.col("input_tokens") == 0) & (F.col("output_tokens") == 0))
    got = filled.groupBy(*by).agg(F.count("*").alias("calls"), missing.alias("missing_usage_calls"), *(F.sum(c).alias(c) for c in known), *(F.avg(c).alias(f"avg_{c}") for c in known), F.max("cost_usd").alias("max_call_cost_usd"))
    return got.join(lower_percentiles(filled, by, "cost_usd", [("p50_call_cost_usd", 0.5), ("p95_call_cost_usd", 0.95)]), by)


def projected_budget(usage: DataFrame, channels: int, steps: int) -> DataFrame:
    return usage.withColumn("projected_cost_usd", F.col("avg_cost_usd") * channels * steps)


def normalised(rows: DataFrame, columns: list[str], lower_better: list[str] = ()) -> DataFrame:
    """Each column to [0, 1] over all rows, turned round where lower is better; 0.5 if all are equal."""
    edges = rows.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for f, n in ((F.min, "lo"), (F.max, "hi"))))
    wide = rows.crossJoin(F.broadcast(edges))  # edges is one row
    for c in columns:
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        share = F.when(span > 0, (F.col(c) - F.col(f"_lo_{c}")) / F.when(span > 0, span)).otherwise(0.5)
        wide = wide.withColumn(c, F.when(span > 0, 1 - share).otherwise(0.5) if c in lower_better else share)
    return wide.select(*rows.columns)


def against_baseline(rows: DataFrame, key: str, baseline: str, columns: list[str]) -> DataFrame:
    """Each column as a ratio to the row of `baseline`; null where that is 0 or missing."""
    base = rows.where(F.col(key) == baseline).agg(*(F.max(c).alias(f"_{c}") for c in columns))
    return rows.crossJoin(F.broadcast(base)).select(key, *(F.try_divide(F.col(c), F.when(F.col(f"_{c}") != 0, F.col(f"_{c}"))).alias(c) for c in columns))  # base is one row


def mean_of_means(rows: DataFrame, inner: list[str], outer: list[str], value: str) -> DataFrame:
    """Mean over groups of the mean within them, ignoring nulls; 0 for none."""
    first = rows.groupBy(*outer, *inner).agg(F.avg(value).alias("m"))
    return first.groupBy(*outer).agg(F.coalesce(F.avg("m"), F.lit(0.0)).alias("mean_of_means"), F.count("*").alias("groups"))
