"""Joins between labels, events and clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curaspark.functions import arrays
from curaspark.operators import trains

UNIT = ["channel_id", "cl"]
NOISE = 0


def overlap(labels: DataFrame) -> DataFrame:
    """Contingency of cluster and true label: one partial aggregation, no join, as both labels sit on a row."""
    return labels.groupBy("channel_id", "cl", "gt").agg(F.count("*").alias("n"))


def overlap_of(curated: DataFrame, truth: DataFrame) -> DataFrame:
    """The same for labels in two tables that share channel_id and spike_id."""
    return overlap(curated.select("channel_id", "spike_id", "cl").join(truth.select("channel_id", "spike_id", "gt"), ["channel_id", "spike_id"]))


def argmax_by(rows: DataFrame, by: list[str], value: str, key: str) -> DataFrame:
    """The key of the greatest value per group, the least key on ties; an aggregate, not a window."""
    top = F.max_by(F.struct(key, value), F.struct(F.col(value), -F.col(key))).alias("top")
    return rows.groupBy(*by).agg(top).select(*by, f"top.{key}", f"top.{value}")


def active_clusters(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("cl") != NOISE).select("channel_id", "cl").distinct()


def _guarded(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)


def _scored(labels: DataFrame) -> DataFrame:
    """best_matches() with the channel's true events; one scan, everything after it works on the contingency."""
    total = F.sum(F.when(F.col("gt") != NOISE, F.col("n"))).over(Window.partitionBy("channel_id"))
    table = overlap(labels).withColumn("n_gt", F.sum("n").over(Window.partitionBy("channel_id", "gt"))).withColumn("channel_gt", total)
    rank = F.when(F.col("gt") != NOISE, F.struct(F.col("n"), -F.col("gt")))
    best = F.max_by(F.struct("gt", "n", "n_gt"), rank)
    got = table.where(F.col("cl") != NOISE).groupBy(*UNIT).agg(F.sum("n").alias("n_curated"), best.alias("b"), F.max("channel_gt").alias("channel_gt"))
    n, g, tp = F.col("n_curated"), F.coalesce("b.n_gt", F.lit(0)), F.coalesce("b.n", F.lit(0))
    precision, recall = _guarded(tp.cast("double"), n), _guarded(tp.cast("double"), g)
    return got.select(
        "channel_id",
        F.col("cl").alias("curated_id"),
        F.col("b.gt").alias("matched_gt_id"),
        _guarded(tp.cast("double"), F.greatest(n, g)).alias("agreement"),
        n.alias("n_curated_spikes"),
        g.cast("bigint").alias("n_gt_spikes"),
        tp.cast("bigint").alias("tp"),
        (n - tp).cast("bigint").alias("fp"),
        (g - tp).cast("bigint").alias("fn"),
        precision.alias("precision"),
        recall.alias("recall"),
        _guarded(2 * precision * recall, precision + recall).alias("f1_score"),
        F.coalesce("channel_gt", F.lit(0)).alias("channel_gt"),
    )


def best_matches(labels: DataFrame) -> DataFrame:
    """Each cluster with the true unit it overlaps most, counts and scores; null if it has noise only."""
    return _scored(labels).drop("channel_gt")


def overall_performance(labels: DataFrame) -> DataFrame:
    """Per channel: micro scores with the global miss count, macro means and matched clusters."""
    sums = _scored(labels).groupBy("channel_id").agg(
        F.count("*").alias("n_curated"),
        F.count("matched_gt_id").alias("n_matched"),
        F.sum("tp").alias("total_tp"),
        F.sum("fp").alias("total_fp"),
        F.max("channel_gt").alias("total_gt_spikes"),
        F.avg("precision").alias("mean_precision"),
        F.avg("recall").alias("mean_recall"),
        F.avg("f1_score").alias("mean_f1"),
        F.avg("agreement").alias("mean_agreement"),
    )
    tp, fp, fn = F.col("total_tp"), F.col("total_fp"), F.col("total_gt_spikes") - F.col("total_tp")
    precision, recall = _guarded(tp.cast("double"), tp + fp), _guarded(tp.cast("double"), tp + fn)
    return sums.select("channel_id", "n_curated", "n_matched", "total_tp", "total_fp", fn.alias("total_fn"), "total_gt_spikes", precision.alias("precision"), recall.alias("recall"), _guarded(2 * precision * recall, precision + recall).alias("f1"), "mean_precision", "mean_recall", "mean_f1", "mean_agreement")


def band_join(left: DataFrame, right: DataFrame, tolerance: float, by: list[str], left_time: str = "t", right_time: str = "u") -> DataFrame:
    """Pairs with |t - u| <= tolerance: an equi-join on time bins of that width, right rows in three bins."""
    slot = F.floor(F.col(left_time) / tolerance).cast("bigint")
    near = F.floor(F.col(right_time) / tolerance).cast("bigint")
    probes = right.withColumn("slot", F.explode(F.array(near - 1, near, near + 1)))
    return left.withColumn("slot", slot).join(probes, [*by, "slot"]).where(F.abs(F.col(left_time) - F.col(right_time)) <= tolerance).drop("slot")


def coincident_units(events: DataFrame, truth: DataFrame, tolerance: float) -> DataFrame:
    """events (channel_id, spike_id, t) with the greatest true unit among truth (channel_id, u, unit) in reach, else 0."""
    hits = band_join(events.select("channel_id", "spike_id", "t"), truth, tolerance, ["channel_id"])
    units = hits.groupBy("channel_id", "spike_id").agg(F.max("unit").alias("unit"))
    return events.join(units, ["channel_id", "spike_id"], "left").withColumn("unit", F.coalesce("unit", F.lit(NOISE).cast("bigint")))


def cross_correlogram(spikes: DataFrame, pairs: DataFrame | None, lag: float, bins: int) -> DataFrame:
    """Histogram of u - t over 2 * bins + 1 equal lags for each pair (channel_id, a, b) with a <= b; None: all active pairs.

    Every lag is present; the zero lag of a cluster with itself is blanked; clusters of one event are left out. Events
    meet within blocks of clusters, and a pair is one row until its lags are laid out.
    """
    if pairs is None:
        got = trains.all_lag_counts(spikes, active_clusters(spikes), lag, bins)
    else:
        got = trains.lag_counts(spikes, pairs, lag, bins).where("n_a > 1 and n_b > 1")
    rows = got.select("channel_id", "a", "b", F.posexplode("lags").alias("pos", "n")).withColumn("lag", F.col("pos") - bins)
    n = F.when((F.col("lag") == 0) & (F.col("a") == F.col("b")), 0).otherwise(F.col("n"))
    return rows.select("channel_id", "a", "b", "lag", n.cast("bigint").alias("n"))


def size_classes(spikes: DataFrame, least_large: int) -> DataFrame:
    sizes = spikes.where(F.col("cl") != NOISE).groupBy(*UNIT).agg(F.count("*").alias("n"))
    return sizes.withColumn("size_class", F.when(F.col("n") < least_large, "small").otherwise("large"))


def small_large_pairs(classes: DataFrame) -> DataFrame:
    """Every small cluster with every large one of its channel: cluster tables are short, events are not touched."""
    small = classes.where("size_class = 'small'").select("channel_id", F.col("cl").alias("small"), F.col("n").alias("n_small"))
    large = classes.where("size_class = 'large'").select("channel_id", F.col("cl").alias("large"), F.col("n").alias("n_large"))
    return small.join(large, "channel_id")


def least_by_size(classes: DataFrame) -> DataFrame:
    """Small clusters, and of the large ones of a channel that have equally many events the one of least id.

    Of pairs whose score depends on their sizes alone no others can be best, if the least id wins ties.
    """
    least = F.when(F.col("size_class") == "large", F.lit(0)).otherwise(F.col("cl"))
    return classes.groupBy("channel_id", "n", "size_class", least.alias("_own")).agg(F.min("cl").alias("cl")).select("channel_id", "cl", "n", "size_class")


def first_accepted(pairs: DataFrame, accepted: Column) -> DataFrame:
    """For each small cluster the first large one, in order of id, that `accepted` takes; null if none."""
    return pairs.groupBy("channel_id", "small").agg(F.min(F.when(accepted, F.col("large"))).alias("large"))


def not_among(pairs: DataFrame, known: DataFrame, on: list[str], everything: DataFrame | None = None) -> DataFrame:
    """Pairs that are not known; `everything` instead if that leaves none."""
    rest = pairs.join(known, on, "left_anti")
    if everything is None:
        return rest
    empty = rest.limit(1).agg((F.count("*") == 0).alias("none"))
    return rest.unionByName(everything.join(F.broadcast(empty.where("none")), F.lit(True), "left_semi"))


def template_similarity(templates: DataFrame, how: str = "pearson") -> DataFrame:
    """Similarity of every two clusters of a channel, a < b; templates are one row a cluster."""
    a = templates.select("channel_id", F.col("cl").alias("a"), F.col("template").alias("x"))
    b = templates.select("channel_id", F.col("cl").alias("b"), F.col("template").alias("y"))
    return a.join(b, "channel_id").where("a < b").select("channel_id", "a", "b", arrays.SIMILARITIES[how](F.col("x"), F.col("y")).alias("similarity"))


def merged_intervals(spikes: DataFrame, pairs: DataFrame, tref: float) -> DataFrame:
    """Interval violations of the union of both clusters of each pair (channel_id, a, b); events are not copied by pair."""
    got = trains.gap_classes(spikes, pairs, lambda gap: np.where(gap < tref, 0, 1), [tref])
    n = F.col("n_a") + F.when(F.col("a") == F.col("b"), 0).otherwise(F.col("n_b"))
    got = got.select("channel_id", "a", "b", n.alias("n_merged"), F.get("joint", F.lit(0)).alias("v")).where("n_merged > 0")
    n = F.col("n_merged")
    return got.select("channel_id", "a", "b", "n_merged", F.when(n > 1, F.col("v") / F.when(n > 1, n - 1)).otherwise(0.0).alias("merged_isi"))


def mode_delta(left: DataFrame, right: DataFrame, on: str, value: str) -> DataFrame:
    """Both summaries by key, missing values as 0, and right less left."""
    a, b = left.select(on, F.col(value).alias("left_value")), right.select(on, F.col(value).alias("right_value"))
    zero = F.lit(0.0)
    x, y = F.coalesce("left_value", zero), F.coalesce("right_value", zero)
    return a.join(b, on, "full_outer").select(on, x.alias("left_value"), y.alias("right_value"), (y - x).alias("delta"))


def prefix_priced(rows: DataFrame, prices: DataFrame, name: str = "model") -> DataFrame:
    """rows with the prices of the longest key that equals the lower-cased name or is followed by '-' in it.

    Only distinct names are looked up: each prefix of one up to a '-' by equality. Names without a price, and null ones,
    keep their rows with null prices.
    """
    own = rows.select(F.col(name).alias("_name")).distinct()
    words = F.split(F.lower("_name"), "-")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, F.lit(1), i), "-"))
    columns = [c for c in prices.columns if c != "key"]
    hits = own.where("_name is not null").withColumn("_key", F.explode(prefixes)).join(prices, F.col("_key") == F.col("key"))
    best = hits.groupBy("_name").agg(F.max_by(F.struct("key", *columns), F.length("key")).alias("_best"))
    found = rows.join(best, F.col(name) == F.col("_name"), "left")
    return found.select(*rows.columns, F.col("_best.key").alias("pricing_key"), *(F.col(f"_best.{c}").alias(c) for c in columns))
