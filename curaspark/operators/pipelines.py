"""Whole curation runs: phases over sessions with injected decisions, replays of action sheets, and student evaluation.

A run needs the contingency of a channel (fine label, coarse label, true label, count) and its tree; both are short, so
channels are curated side by side, each in one task. Decisions are a callable or come from a table; none calls a model.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curaspark.operators import curation, matching, units
from curaspark.operators.state import Session

#: Decides on a cluster of a session: KEEP, DISCARD or SPLIT.
Phase1 = Callable[[Session, int], str]
#: Decides on a small and a large cluster: MERGE, NOT_MERGE or DISCARD.
Phase2 = Callable[[Session, int, int], str]


def by_purity(threshold: float = 0.8) -> Phase1:
    """The right decision of phase 1 from true labels."""

    def decide(session: Session, cluster: int) -> str:
        unit, purity = session.dominant(cluster)
        return "DISCARD" if unit is None else "SPLIT" if purity < threshold else "KEEP"

    return decide


def by_dominant() -> Phase2:
    """The right decision of phase 2: MERGE if both clusters are mostly of one unit."""

    def decide(session: Session, small: int, large: int) -> str:
        unit = session.dominant(small)[0]
        return "DISCARD" if unit is None else "MERGE" if session.dominant(large)[0] == unit else "NOT_MERGE"

    return decide


def run_phases(session: Session, phase1: Phase1, phase2: Phase2, least: int = 500, large: int = 4000, final: int = 5000) -> list[tuple[str, int, int | None, str]]:
    """Size filter, recursive validity and splits, first accepted merge of small into large clusters, final size filter.

    Returns phase, cluster, target and action, in order. Large clusters are validated again before merging; without one
    every small cluster is discarded, and so is a small cluster that none takes.
    """
    log: list[tuple[str, int, int | None, str]] = []

    def discard(phase: str, cluster: int) -> None:
        session.discard(cluster)
        log.append((phase, cluster, None, "DISCARD"))

    for cluster in session.active():
        if session.size(cluster) < least:
            discard("Phase0", cluster)
    queue = session.active()
    while queue:
        cluster = queue.pop(0)
        action = phase1(session, cluster)
        if action == "DISCARD":
            discard("Phase1", cluster)
        elif action == "SPLIT" and session.merged(cluster):
            before = len(session.active())
            ids = session.split_last(cluster)
            log.append(("Phase1", cluster, ids[1], "SPLIT"))
            if len(session.active()) != before or not session.alive(cluster):
                queue[:0] = [i for i in ids if session.alive(i)]
        else:
            log.append(("Phase1", cluster, None, "KEEP"))
    sizes = {c: session.size(c) for c in session.active()}
    smalls, larges = [c for c, n in sizes.items() if n < large], []
    for cluster in (c for c, n in sizes.items() if n >= large):
        if phase1(session, cluster) == "DISCARD":
            discard("Phase2", cluster)
        else:
            larges.append(cluster)
    for small in smalls:
        for target in larges:
            action = phase2(session, small, target)
            if action == "MERGE":
                session.merge([small, target], target)
                log.append(("Phase2", small, target, "MERGE"))
                break
            if action == "DISCARD":
                discard("Phase2", small)
                break
        else:
            discard("Phase2", small)
    for cluster in session.active():
        if session.size(cluster) < final:
            discard("Phase3", cluster)
    return log


def replay_sheet(session: Session, sheet: Iterable[tuple[str, int, int | None]]) -> list[tuple[int, str, int, int | None, bool]]:
    """Applies human actions (action, cluster, target) in order; a step on a missing cluster is skipped, not an error."""
    out = []
    for step, (action, cluster, target) in enumerate(sheet):
        live = session.alive(cluster) and (target is None or session.alive(target))
        if live and action == "split":
            if session.merged(cluster):
                session.split_last(cluster)
            else:
                live = False
        elif live and action == "discard":
            session.discard(cluster)
        elif live and action == "merge" and target is not None:
            session.merge([cluster, target], target)
        out.append((step, action, cluster, target, live))
    return out


def evaluate_student(session: Session, student: Callable[[Session, int], str], threshold: float = 0.8, merge_in_phase1: bool = True) -> list[tuple[int, str, int, int | None, str, str]]:
    """A student's action against the right one for each cluster, the right one applied: step, phase, cluster, target, both."""
    right1, out = by_purity(threshold), []
    queue, done = deque(session.active()), set()
    while queue:
        cluster = queue.popleft()
        if cluster in done or not session.alive(cluster):
            continue
        done.add(cluster)
        gt, chosen = right1(session, cluster), student(session, cluster)
        target = None
        if gt == "KEEP" and merge_in_phase1:
            target = session.alike(cluster)  # as by_dominant() would merge
            gt = "MERGE" if target is not None else gt
        out.append((len(out), "phase1", cluster, target, gt, chosen))
        if gt == "DISCARD":
            session.discard(cluster)
        elif gt == "MERGE" and target is not None:
            session.merge([cluster, target], target)
        elif gt == "SPLIT":
            ids = session.split_last(cluster) if session.merged(cluster) else session.split_fine(cluster)
            queue += [i for i in ids if i not in done]
    return out


def _sessions(labels: DataFrame, tree: DataFrame, run: Callable[[Session], list[tuple]], columns: list[str], schema: str) -> DataFrame:
    def one(key, counts: pd.DataFrame, merges: pd.DataFrame) -> pd.DataFrame:
        label = {int(oc): int(cl) for oc, cl in counts[["oc", "cl"]].drop_duplicates().itertuples(index=False)}
        rows = [(int(d), int(s), 1.0) for d, s in merges.sort_values("step")[["dst", "src"]].itertuples(index=False)]
        out = run(Session(counts[["oc", "gt", "n"]], label, rows))
        frame = pd.DataFrame([(key[0], i, *x) for i, x in enumerate(out)], columns=["channel_id", "seq", *columns])
        return frame.astype({"target_id": "Int64"})

    counts = labels.groupBy("channel_id", "oc", "cl", "gt").agg(F.count("*").alias("n")).toDF("channel_id", "oc", "cl", "gt", "n")
    tree = tree.select(F.col("channel_id").alias("channel_id"), "step", "dst", "src")
    return counts.groupBy("channel_id").cogroup(tree.groupBy("channel_id")).applyInPandas(one, f"channel_id long, seq int, {schema}")


def curated(labels: DataFrame, tree: DataFrame, phase1: Phase1, phase2: Phase2, least: int = 500, large: int = 4000, final: int = 5000) -> DataFrame:
    """The action log of the four phases for every channel."""
    return _sessions(labels, tree, lambda s: run_phases(s, phase1, phase2, least, large, final), ["phase", "cluster_id", "target_id", "action"], "phase string, cluster_id long, target_id long, action string")


def student_predictions(labels: DataFrame, tree: DataFrame, student: Callable[[Session, int], str], threshold: float = 0.8) -> DataFrame:
    """Prediction rows of a student for every channel, under teacher forcing."""
    return _sessions(labels, tree, lambda s: evaluate_student(s, student, threshold), ["step", "phase", "cluster_id", "target_id", "gt_action", "student_action"], "step int, phase string, cluster_id long, target_id long, gt_action string, student_action string")


def heuristic_labels(spikes: DataFrame, similarity: DataFrame, tref: float, least: int = 500, large: int = 4000, final: int = 5000, **limits: float) -> DataFrame:
    """Events relabelled by the rule-based run: size filter, merges or discards of small clusters, final size filter.

    similarity: channel_id, small, large, corr for any pairs. Sizes and decisions are by cluster, so filters and moves are
    composed on that short table and events take their label in one join; merged intervals are counted for the best
    pair of each small cluster only.
    """
    sizes = spikes.where(F.col("cl") != matching.NOISE).groupBy(*matching.UNIT).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    classes = sizes.withColumn("size_class", F.when(F.col("n") < large, "small").otherwise("large"))
    ends = {c: classes.where(F.col("size_class") == c).select("channel_id", F.col("cl").alias(c)) for c in ("small", "large")}
    pairs = similarity.join(ends["small"], ["channel_id", "small"], "left_semi").join(ends["large"], ["channel_id", "large"], "left_semi")
    best = curation.best_by_correlation(pairs)
    merged = matching.merged_intervals(spikes, best.select("channel_id", F.col("small").alias("a"), F.col("large").alias("b")), tref)
    scored = best.join(merged.select("channel_id", F.col("a").alias("small"), F.col("b").alias("large"), "merged_isi"), ["channel_id", "small", "large"])
    actions = curation.heuristic_merges(classes, units.interval_violations(spikes, tref), scored, **limits)
    new = F.when(F.col("action") == "MERGE", F.col("best_large")).otherwise(F.lit(matching.NOISE).cast("bigint"))
    moved = actions.select("channel_id", "cl", "n", new.alias("new"))
    kept = classes.where("size_class = 'large'").select("channel_id", "cl", "n", F.col("cl").alias("new"))
    total = F.sum("n").over(Window.partitionBy("channel_id", "new"))  # over clusters, not events
    final_label = F.when(total >= final, F.col("new")).otherwise(F.lit(matching.NOISE).cast("bigint"))
    labels = moved.unionByName(kept).where(F.col("new") != matching.NOISE).select("channel_id", "cl", final_label.alias("new"))
    return spikes.join(labels, matching.UNIT, "left").withColumn("cl", F.coalesce("new", F.when(F.col("cl").isNotNull(), F.lit(matching.NOISE).cast("bigint")))).drop("new")


def training_pairs(spikes: DataFrame, expert: DataFrame, least_large: int, every: int = 8) -> DataFrame:
    """Merge samples: pairs experts merged as MERGE, a hashed share of the others as NOT_MERGE."""
    from curaspark.operators.datasets import negative_pairs

    pairs = matching.small_large_pairs(matching.size_classes(spikes, least_large)).select("channel_id", "small", "large")
    positive = pairs.join(expert, ["channel_id", "small", "large"], "left_semi").withColumn("label_action", F.lit("MERGE"))
    return positive.unionByName(negative_pairs(pairs, expert, ["channel_id"], every).withColumn("label_action", F.lit("NOT_MERGE")))
