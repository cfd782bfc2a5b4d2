"""Canonical views over parquet tables.

spikes: channel_id, spike_id, t (seconds), amp, oc (fine label), cl (coarse label), gt (true label, 0 is noise)
waves:  channel_id, spike_id, wf (array of doubles), cl, gt
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: True labels of event types; errors are noise.
EVENT_UNITS = {"error": 0, "click": 1, "purchase": 2, "signup": 3, "view": 4}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a spike train: a user is a cluster of the channel user_id % 4, five fine labels each."""
    unit = F.lit(None).cast("bigint")
    for name, number in EVENT_UNITS.items():
        unit = F.when(F.col("event_type") == name, F.lit(number).cast("bigint")).otherwise(unit)
    user = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        (user % 4).cast("bigint").alias("channel_id"),
        F.col("event_id").cast("bigint").alias("spike_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
        F.col("value").alias("amp"),
        ((user + 1) * 10 + F.col("event_id") % 5).cast("bigint").alias("oc"),
        (user + 1).cast("bigint").alias("cl"),
        unit.alias("gt"),
    )


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as waveforms: label + 1 is the cluster, three true units by vec_id."""
    return table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 2).cast("bigint").alias("channel_id"),
        F.col("vec_id").cast("bigint").alias("spike_id"),
        F.col("embedding").cast("array<double>").alias("wf"),
        (F.col("label") + 1).cast("bigint").alias("cl"),
        (F.col("vec_id") % 3).cast("bigint").alias("gt"),
    )


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a large label table: supplier against line number, returned lines as noise."""
    return table(spark, sf_dir, "lineitem").select(
        F.lit(0).cast("bigint").alias("channel_id"),
        (F.col("l_suppkey") + 1).cast("bigint").alias("cl"),
        F.when(F.col("l_returnflag") == "R", 0).otherwise(F.col("l_linenumber")).cast("bigint").alias("gt"),
    )


def merge_tree(spikes_view: DataFrame) -> DataFrame:
    """The ordered tree that turns fine labels into coarse ones: each fine label but the least merges into it."""
    from pyspark.sql import Window

    fine = spikes_view.groupBy("channel_id", "cl").agg(F.sort_array(F.collect_set("oc")).alias("ocs"))  # a cluster's fine labels are few
    pairs = fine.select("channel_id", F.get("ocs", F.lit(0)).alias("dst"), F.explode(F.slice("ocs", F.lit(2), F.greatest(F.size("ocs") - 1, F.lit(0)))).alias("src"))
    step = F.row_number().over(Window.partitionBy("channel_id").orderBy("dst", "src")) - 1
    return pairs.select("channel_id", step.cast("int").alias("step"), "dst", "src")
