"""Rows for training and evaluation: splits, samples, filters and flat records."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sampled_split(ids: list[str], n_train: int, n_eval: int, seed: int) -> tuple[list[str], list[str]]:
    """Disjoint seeded samples of a short list of channel names; fails if it is too short."""
    if n_train + n_eval > len(ids):
        raise ValueError(f"{n_train} + {n_eval} channels asked for, {len(ids)} given")
    picked = random.Random(seed).sample(sorted(ids), n_train + n_eval)
    return picked[:n_train], picked[n_train:]


def of_channels(rows: DataFrame, channels: list[str], source_prefix: str | None = None) -> DataFrame:
    """Rows of the channels, whatever their case, and of sources with the prefix."""
    out = rows.where(F.upper("channel").isin([c.upper() for c in channels]))
    return out.where(F.startswith("source", F.lit(source_prefix))) if source_prefix else out


def human_actions(rows: DataFrame) -> DataFrame:
    return rows.where(F.startswith("source", F.lit("expert_")) & F.upper("label_action").isin("SPLIT", "MERGE", "DISCARD"))


def after_prefix(rows: DataFrame, by: list[str], order: str, prefix: Column) -> DataFrame:
    """Rows from the first that is not `prefix` on, in order."""
    seen = F.max(F.when(prefix, 0).otherwise(1)).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_seen", seen).where("_seen = 1").drop("_seen")


def systematic_sample(rows: DataFrame, by: list[str], order: str, k: int) -> DataFrame:
    """k rows of each group spread evenly from first to last in order; all if there are no more."""
    w = Window.partitionBy(*by)
    ranked = rows.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / max(k - 1, 1)))
    return ranked.where((F.col("_n") <= k) | F.array_contains(picks, F.col("_i").cast("bigint"))).drop("_i", "_n")


def hashed_sample(rows: DataFrame, by: list[str], key: str, k: int) -> DataFrame:
    """k rows of each group of least hash of a key; the same at every run and partitioning."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64(key), key))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def negative_pairs(pairs: DataFrame, expert: DataFrame, by: list[str], every: int = 8) -> DataFrame:
    """One in `every` of each group's pairs that experts did not merge, at least one, by least hash."""
    rest = pairs.join(expert, [*by, "small", "large"], "left_anti")
    w = Window.partitionBy(*by)
    ranked = rest.withColumn("_rank", F.row_number().over(w.orderBy(F.xxhash64("small", "large"), "small", "large"))).withColumn("_n", F.count("*").over(w))
    return ranked.where(F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") / every))).drop("_rank", "_n")


def flat(rows: DataFrame, nested: list[str]) -> DataFrame:
    """Fields of nested columns as columns of their own, prefixed, and each nested column as JSON."""
    plain = [F.col(c) for c in rows.columns if c not in nested]
    fields = [F.col(f"{c}.{f.name}").alias(f"{c}_{f.name}") for c in nested for f in rows.schema[c].dataType.fields]
    return rows.select(*plain, *fields, *(F.to_json(c).alias(f"{c}_json") for c in nested))


def without_nulls(rows: DataFrame) -> DataFrame:
    """Null integers as -1, null floating-point numbers as NaN, null text as ''."""
    fill = {"int": F.lit(-1), "bigint": F.lit(-1), "double": F.lit(float("nan")), "float": F.lit(float("nan")), "string": F.lit("")}
    return rows.select(*(F.coalesce(F.col(c), fill[t].cast(t)).alias(c) if t in fill else F.col(c) for c, t in rows.dtypes))


def balanced_keeps(steps: DataFrame, by: list[str]) -> DataFrame:
    """Clusters that no expert step touches, as KEEP samples."""
    touched = steps.where("gt_action <> 'KEEP'").select(*by, "cluster_id").distinct()
    return steps.join(touched, [*by, "cluster_id"], "left_anti").withColumn("gt_action", F.lit("KEEP"))


def within_bounds(rows: DataFrame, frame: str, before: int, after: int, n_frames: Column | int) -> DataFrame:
    """Rows whose snippet from `before` frames ahead to `after` behind lies in the recording."""
    last = n_frames if isinstance(n_frames, Column) else F.lit(n_frames)
    return rows.where((F.col(frame) >= before) & (F.col(frame) + after < last))
