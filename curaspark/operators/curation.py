"""Filters, decisions and the small state of curation.

Decisions need only counts, so they run on the contingency table (channel_id, cl, gt, n), never on events. The state
of a session is a table (channel_id, oc, cl): an operation relabels fine labels, and events take their label in one
join at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curaspark.operators.matching import NOISE, UNIT, overlap


def size_filter(spikes: DataFrame, least: int) -> DataFrame:
    """DISCARD for clusters below `least` events, KEEP for others."""
    sizes = spikes.where(F.col("cl") != NOISE).groupBy(*UNIT).agg(F.count("*").alias("n"))
    return sizes.withColumn("action", F.when(F.col("n") < least, "DISCARD").otherwise("KEEP"))


def size_filtered(spikes: DataFrame, least: int) -> DataFrame:
    """Events with clusters below `least` set to noise."""
    small = size_filter(spikes, least).where("action = 'DISCARD'").select(*UNIT, F.lit(True).alias("_gone"))
    return spikes.join(small, UNIT, "left").withColumn("cl", F.when(F.col("_gone"), F.lit(NOISE).cast("bigint")).otherwise(F.col("cl"))).drop("_gone")


def small_fine_labels_cleared(spikes: DataFrame, least: int) -> DataFrame:
    """Events with both labels set to 0 where a positive fine label has fewer than `least` events."""
    sizes = spikes.where("oc > 0").groupBy("channel_id", "oc").agg((F.count("*") < least).alias("_few"))
    few = F.coalesce("_few", F.lit(False))
    joined = spikes.join(sizes, ["channel_id", "oc"], "left")
    zero = F.lit(0).cast("bigint")
    return joined.select("channel_id", "spike_id", F.when(few, zero).otherwise(F.col("oc")).alias("oc"), F.when(few, zero).otherwise(F.col("cl")).alias("cl"))


def purity(labels: DataFrame) -> DataFrame:
    """Dominant true unit of each cluster (noise never dominates) over all its events, noise included."""
    table = overlap(labels.where(F.col("cl") != NOISE))
    noise = F.col("gt") == NOISE
    top = F.max_by(F.struct("gt", "n"), F.when(~noise, F.struct(F.col("n"), -F.col("gt"))))
    got = table.groupBy(*UNIT).agg(F.sum("n").alias("n_spikes"), F.sum(F.when(noise, F.col("n")).otherwise(0)).alias("n_noise"), top.alias("b"))
    return got.select(*UNIT, "n_spikes", "n_noise", F.col("b.gt").alias("dominant_gt"), F.col("b.n").alias("dominant_n"), F.coalesce(F.col("b.n") / F.col("n_spikes"), F.lit(0.0)).alias("purity"))


def oracle_actions(labels: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The right action for each cluster by itself: DISCARD, SPLIT, MERGE (into the least other of its unit), KEEP."""
    state = purity(labels)
    shared = Window.partitionBy("channel_id", "dominant_gt")
    first = F.min("cl").over(shared)
    second = F.min(F.when(F.col("cl") != F.col("first"), F.col("cl"))).over(shared)
    rows = state.withColumn("first", first).withColumn("second", second)
    other = F.when(F.col("cl") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    rows = rows.withColumn("other", F.when(F.col("dominant_gt").isNotNull(), other))
    action = F.when(F.col("n_noise") == F.col("n_spikes"), "DISCARD").when(F.col("purity") < threshold, "SPLIT").when(F.col("other").isNotNull(), "MERGE").otherwise("KEEP")
    return rows.withColumn("action", action).select(*UNIT, "n_spikes", "dominant_gt", "purity", "action", F.when(F.col("action") == "MERGE", F.col("other")).alias("target_id"))


def next_action(labels: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The one action a channel needs first: DISCARD before SPLIT before MERGE before KEEP, least cluster first.

    A MERGE takes the first unit, in order of its least cluster, that two clusters share, whatever their purity.
    """
    actions = oracle_actions(labels, threshold)
    rank = F.when(F.col("action") == "DISCARD", 0).when(F.col("action") == "SPLIT", 1).when(F.col("action") == "MERGE", 2).otherwise(3)
    best = actions.groupBy("channel_id").agg(F.min_by(F.struct("action", "cl", "target_id"), F.struct(rank, F.col("cl"))).alias("a"))
    return best.select("channel_id", "a.action", F.col("a.cl").alias("cluster_id"), "a.target_id")


def merge_candidates(labels: DataFrame) -> DataFrame:
    """Clusters by shared dominant unit, where two or more share it."""
    got = purity(labels).where("dominant_gt is not null").groupBy("channel_id", "dominant_gt").agg(F.sort_array(F.collect_list("cl")).alias("clusters"))  # clusters of a channel, not events
    return got.where(F.size("clusters") > 1).select("channel_id", "dominant_gt", F.size("clusters").cast("bigint").alias("n_clusters"), F.array_join(F.transform("clusters", lambda c: c.cast("string")), ",").alias("clusters"))


def best_by_correlation(pairs: DataFrame) -> DataFrame:
    """The large cluster that correlates best with each small one, the least on ties, of pairs (channel_id, small, large, corr)."""
    best = F.max_by(F.struct("large", "corr"), F.struct(F.col("corr"), -F.col("large"))).alias("b")
    return pairs.where("corr > -1").groupBy("channel_id", "small").agg(best).select("channel_id", "small", "b.large", "b.corr")


def heuristic_merges(sizes: DataFrame, rates: DataFrame, pairs: DataFrame, least_corr: float = 0.3, most_isi: float = 0.005, early_isi: float = 0.1, early_n: int = 1000) -> DataFrame:
    """Small clusters: DISCARD early by violations and size; MERGE into the best large one by correlation, or DISCARD.

    sizes: channel_id, cl, n, size_class; rates: channel_id, cl, rate; pairs: channel_id, small, large, corr, merged_isi,
    all of them or those of best_by_correlation(), as no others decide.
    """
    small = sizes.where("size_class = 'small'").join(rates, UNIT)
    best = pairs.where("corr > -1").groupBy("channel_id", F.col("small").alias("cl")).agg(F.max_by(F.struct("large", "corr", "merged_isi"), F.struct(F.col("corr"), -F.col("large"))).alias("b"))
    rows = small.join(best, UNIT, "left")
    early = (F.col("rate") > early_isi) & (F.col("n") < early_n)
    take = F.coalesce((F.col("b.corr") > least_corr) & (F.col("b.merged_isi") < most_isi), F.lit(False))
    action = F.when(early, "DISCARD").when(take, "MERGE").otherwise("DISCARD")
    return rows.withColumn("action", action).select(*UNIT, "n", "rate", F.when(~early, F.col("b.large")).alias("best_large"), F.when(~early, F.col("b.corr")).alias("best_corr"), F.when(~early, F.col("b.merged_isi")).alias("best_merged_isi"), "action")


def split_needed(rates: DataFrame, composition: DataFrame, most_isi: float = 0.005) -> DataFrame:
    """Clusters with more violations than `most_isi` and more than one fine label."""
    return rates.join(composition, UNIT).withColumn("split", (F.col("rate") > most_isi) & (F.col("n_overclusters") > 1))


def checked_actions(actions: DataFrame) -> DataFrame:
    """Actions (session, step, action_type, cluster_id, target_id) with what is wrong with each.

    A step must follow its predecessor, name a known action and a cluster, give MERGE a target, use no cluster that an
    earlier step discarded; KEEP before the last step is worth a warning.
    """
    order = Window.partitionBy("session").orderBy("step")
    rows = actions.withColumn("pos", F.row_number().over(order) - 1).withColumn("last", F.count("*").over(Window.partitionBy("session")) - 1)
    gone = rows.where("action_type = 'DISCARD' and cluster_id is not null").groupBy("session", "cluster_id").agg(F.min("pos").alias("gone_at"))
    rows = rows.join(gone, ["session", "cluster_id"], "left")
    target = gone.select("session", F.col("cluster_id").alias("target_id"), F.col("gone_at").alias("target_gone_at"))
    rows = rows.join(target, ["session", "target_id"], "left")
    known = F.col("action_type").isin("SPLIT", "MERGE", "DISCARD", "KEEP")
    merge = F.col("action_type") == "MERGE"
    return rows.select(
        "session",
        "step",
        "action_type",
        (F.col("step") != F.col("pos")).alias("bad_step"),
        (~F.coalesce(known, F.lit(False))).alias("unknown_action"),
        F.col("cluster_id").isNull().alias("no_cluster"),
        F.coalesce(F.col("gone_at") < F.col("pos"), F.lit(False)).alias("discarded_cluster"),
        F.coalesce(merge & F.col("target_id").isNull(), F.lit(False)).alias("no_target"),
        F.coalesce(merge & (F.col("target_gone_at") < F.col("pos")), F.lit(False)).alias("discarded_target"),
        F.coalesce((F.col("action_type") == "KEEP") & (F.col("pos") < F.col("last")), F.lit(False)).alias("early_keep"),
    )


def statistics(spikes: DataFrame) -> DataFrame:
    """Per channel: events, assigned and noise events, clusters, and sizes by cluster."""
    sizes = spikes.groupBy(*UNIT).agg(F.count("*").alias("n"))
    live = F.col("cl") != NOISE
    return sizes.groupBy("channel_id").agg(
        F.sum("n").alias("n_spikes"),
        F.sum(F.when(live, F.col("n")).otherwise(0)).alias("n_assigned"),
        F.sum(F.when(live, 0).otherwise(F.col("n"))).alias("n_noise"),
        F.count_if(live).alias("n_active"),
        F.map_from_entries(F.collect_list(F.when(live, F.struct("cl", "n")))).alias("sizes"),  # clusters of a channel
    )


def composition(spikes: DataFrame) -> DataFrame:
    return spikes.groupBy(*UNIT).agg(F.count_distinct("oc").alias("n_overclusters"), F.sort_array(F.collect_set("oc")).alias("overclusters"))


def action_log(decisions: DataFrame) -> DataFrame:
    """Discards in the action language: m 0 <cluster>,"<reason>"."""
    return decisions.where("action = 'DISCARD'").select("channel_id", "cl", F.format_string('m 0 %d,"%s"', "cl", F.coalesce("reason", F.lit(""))).alias("line"))
