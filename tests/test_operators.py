"""Small fixtures worked out by hand, and invariants."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curaspark.functions import arrays, text
from curaspark.operators import alignment, curation, datasets, extras, matching, pipelines, retrieval, state, summaries, units
from curaspark.sources import files

LABELS = "channel_id long, cl long, gt long"
EVENTS = "channel_id long, spike_id long, t double, amp double, oc long, cl long, gt long"


def labels(spark, rows):
    return spark.createDataFrame([(0, cl, gt) for cl, gt, n in rows for _ in range(n)], LABELS)


def test_best_match_takes_the_least_unit_on_ties(spark):
    got = matching.best_matches(labels(spark, [(1, 5, 3), (1, 2, 3), (1, 0, 9), (2, 0, 4)])).orderBy("curated_id").collect()
    assert (got[0].matched_gt_id, got[0].tp, got[0].fp, got[0].fn) == (2, 3, 12, 0)
    assert (got[1].matched_gt_id, got[1].tp, got[1].fp, got[1].fn, got[1].f1_score) == (None, 0, 4, 0, 0.0)


def test_overall_counts_misses_over_all_units(spark):
    got = matching.overall_performance(labels(spark, [(1, 1, 8), (1, 2, 2), (0, 2, 5)])).first()
    assert (got.total_tp, got.total_fp, got.total_fn, got.total_gt_spikes) == (8, 2, 7, 15)


def test_published_scores_follow_from_counts():
    tp, n, g = 17857, 25287, 18465
    p, r = tp / n, tp / g
    assert (round(p, 5), round(r, 5), round(2 * p * r / (p + r), 5)) == (0.70617, 0.96707, 0.81628)


def test_purity_counts_noise(spark):
    rows = labels(spark, [(1, 1, 70), (1, 0, 30), (2, 0, 5), (3, 4, 9), (4, 4, 8)])
    got = {r.cl: (r.action, r.target_id) for r in curation.oracle_actions(rows).collect()}
    assert got == {1: ("SPLIT", None), 2: ("DISCARD", None), 3: ("MERGE", 4), 4: ("MERGE", 3)}
    assert curation.next_action(rows).first()[1:3] == ("DISCARD", 2)


def test_interval_edges(spark):
    rows = [(0, i, t, 1.0, 1, cl, 1) for i, (cl, t) in enumerate([(1, 0.0), (1, 1.0), (1, 1.5), (1, 1.5), (2, 3.0)])]
    got = {r.cl: r for r in units.interval_violations(spark.createDataFrame(rows, EVENTS), 1.0).collect()}
    assert (got[1].n_violations, got[1].rate, got[1].rate_by_n, got[1].self_rate) == (2, 2 / 3, 2 / 4, 3 / 4)
    assert (got[2].n_violations, got[2].rate, got[2].self_rate) == (0, 0.0, 1.0)


def test_array_functions_match_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=9), rng.normal(size=9)
    row = spark.createDataFrame([(a.tolist(), b.tolist(), [2.0] * 9)], "a array<double>, b array<double>, c array<double>").select(
        arrays.pearson(F.col("a"), F.col("b")).alias("r"),
        arrays.pearson(F.col("a"), F.col("c"), 0.0).alias("zero"),
        arrays.pearson(F.col("a"), F.col("c"), -1.0).alias("minus"),
        arrays.pearson(F.col("a"), F.col("c")).alias("nan"),
        arrays.cosine(F.col("a"), F.slice("b", 1, 4)).alias("cut"),
        arrays.peak_to_trough(F.col("a")).alias("ptp"),
        F.get(arrays.rescaled(F.col("c")), F.lit(0)).alias("middle"),
        F.get(arrays.centred(F.col("a"), "median"), F.lit(0)).alias("by_median"),
    ).first()
    assert math.isclose(row.r, np.corrcoef(a, b)[0, 1])
    assert (row.zero, row.minus, row.middle) == (0.0, -1.0, 0.5) and math.isnan(row.nan)
    assert math.isclose(row.cut, a[:4] @ b[:4] / np.linalg.norm(a[:4]) / np.linalg.norm(b[:4]))
    assert math.isclose(row.ptp, np.ptp(a)) and math.isclose(row.by_median, a[0] - np.median(a))


def test_replay_is_sequential(spark):
    rows = spark.createDataFrame([(0, oc) for oc in (1, 2, 3, 4)], "channel_id long, oc long")
    tree = spark.createDataFrame([(0, 0, 1, 2), (0, 1, 3, 4), (0, 2, 1, 3)], "channel_id long, step int, dst long, src long")
    got = {r.oc: r.cl for r in state.replayed_map(rows, tree).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1}
    cut = state.last_merge_split(tree, spark.createDataFrame([(0, 1), (0, 9)], "channel_id long, cl long"))
    assert {r.cl: (r.breakaway, r.labels) for r in cut.collect()} == {1: (3, [3, 4]), 9: (None, [])}


def test_reused_destination(spark):
    rows = spark.createDataFrame([(0, oc) for oc in (1, 2, 3)], "channel_id long, oc long")
    tree = spark.createDataFrame([(0, 0, 2, 1), (0, 1, 1, 3)], "channel_id long, step int, dst long, src long")
    assert {r.oc: r.cl for r in state.replayed_map(rows, tree).collect()} == {1: 2, 2: 2, 3: 1}


def test_agglomeration_ties_keep_the_lower_id(spark):
    rows = [(0, cl, n, w) for cl, n, w in ((1, 5, [0.0, 1.0, 2.0]), (2, 5, [0.0, 1.0, 2.0]), (3, 9, [0.0, 1.0, 2.1]), (4, 1, [2.0, 0.0, 0.0]))]
    got = state.agglomerated(spark.createDataFrame(rows, "channel_id long, cl long, n_spikes long, template array<double>"), 0.8).orderBy("step").collect()
    assert [(r.dst, r.src) for r in got] == [(1, 2), (1, 3)]


def test_sessions_undo_and_redo():
    counts = pd.DataFrame({"oc": [1, 2, 3, 4], "gt": [1, 1, 2, 0], "n": [10, 5, 7, 3]})
    s = state.Session(counts, {1: 1, 2: 1, 3: 3, 4: 4}, [(1, 2, 0.9)])
    assert s.next_action() == ("DISCARD", 4, None)
    s.discard(4)
    assert s.active() == [1, 3]
    assert s.split_last(1) == [1, 2] and s.active() == [1, 2, 3] and s.size(2) == 5
    assert s.undo() and s.active() == [1, 3] and s.tree[0] == (1, 2, 0.9)
    assert s.redo() and s.active() == [1, 2, 3]
    assert s.merge([1, 2]) == 1 and s.active() == [1, 3] and not s.redo()
    assert s.split_fine(1) == [1, 5] and s.members(1) == [1]
    s.rename(5, 8)
    assert 8 in s.active() and len(s.history()) == 5
    assert sum(s.size(c) for c in s.active()) == 22


def test_similar_fine_labels_stay_together():
    counts = pd.DataFrame({"oc": [1, 2, 3], "gt": [1, 1, 1], "n": [1, 1, 1]})
    s = state.Session(counts, {1: 1, 2: 1, 3: 1})
    assert s.split_similar(1, {(1, 3): 0.9, (1, 2): 0.1, (2, 3): 0.2}, 0.8) == [1, 4] and s.members(1) == [1, 3]


def test_trajectory_reaches_keep():
    counts = pd.DataFrame({"oc": [1, 2, 3, 4], "gt": [1, 2, 1, 0], "n": [10, 9, 8, 3]})
    steps = state.Session(counts, {1: 1, 2: 1, 3: 3, 4: 4}, [(1, 2, 0.9)]).trajectory()
    assert [s[1] for s in steps] == ["DISCARD", "SPLIT", "MERGE", "KEEP"] and steps[-1][4] == 2


def test_band_edges(spark):
    events = spark.createDataFrame([(0, 1, 10.0), (0, 2, 11.0), (0, 3, 20.0)], "channel_id long, spike_id long, t double")
    truth = spark.createDataFrame([(0, 10.5, 1), (0, 10.25, 2), (0, 11.5, 1)], "channel_id long, u double, unit long")
    assert {r.spike_id: r.unit for r in matching.coincident_units(events, truth, 0.5).collect()} == {1: 2, 2: 1, 3: 0}


def test_cross_correlogram_blanks_zero_lag(spark):
    rows = [(0, i, float(t), 1.0, 1, cl, 1) for i, (cl, t) in enumerate([(1, 0), (1, 2), (2, 1), (2, 3), (3, 9)])]
    s = spark.createDataFrame(rows, EVENTS)
    pairs = spark.createDataFrame([(0, 1, 1), (0, 1, 2), (0, 1, 3)], "channel_id long, a long, b long")
    got = {(r.a, r.b, r.lag): r.n for r in matching.cross_correlogram(s, pairs, 2.0, 2).collect()}
    assert len(got) == 10 and got[1, 1, 0] == 0 and got[1, 1, 2] == 1 and got[1, 2, 1] == 2 and got[1, 2, -1] == 1 and got[1, 2, -2] == 0


def test_edit_distance_and_rolling(spark):
    rows = [("a", 0, "SPLIT", "SPLIT"), ("a", 1, "MERGE", "DISCARD"), ("a", 2, "DISCARD", None)]
    p = spark.createDataFrame(rows, "session string, step int, gt_action string, student_action string")
    assert alignment.edit_distance(p, "session", "step").first().edit_distance == 2
    n = spark.range(1, 21).select(F.lit("g").alias("g"), "id", F.col("id").cast("double").alias("v"))
    r = [x.rolling for x in alignment.rolling_accuracy(n, "g", "id", "v").orderBy("id").collect()]
    assert r[:3] == [3.0, 3.5, 4.0] and r[-1] == 17.5


def test_lower_percentiles(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 2.0)] + [("c", float(i)) for i in range(20)], "k string, v double")
    got = {r.k: (r.p50, r.p95) for r in summaries.lower_percentiles(rows, ["k"], "v", [("p50", 0.5), ("p95", 0.95)]).collect()}
    assert got == {"a": (1.0, 1.0), "b": (1.0, 1.0), "c": (9.0, 18.0)}


def test_normalise_is_half_without_range(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 4.0)], "k string, x double, y double")
    assert {r.k: (r.x, r.y) for r in summaries.normalised(rows, ["x", "y"], ["y"]).collect()} == {"a": (0.5, 1.0), "b": (0.5, 0.0)}


def test_memory_never_retrieves_itself(spark):
    rows = [("s", i, "p", [1.0, float(i)], [1.0], "KEEP", "r" if i != 1 else " ") for i in range(4)]
    m = spark.createDataFrame(rows, "session string, seq long, phase string, template array<double>, features array<double>, gt_action string, gt_reasoning string")
    got = {(r.seq, r["rank"]): r.entry_seq for r in retrieval.retrieved(m, m, 2).collect()}
    assert got == {(1, 1): 0, (2, 1): 0, (3, 1): 2, (3, 2): 0}


def test_actions_are_parsed(spark):
    rows = [("s 5",), ("m 3 4",), ("m 0 228.0",), ("x",), ("s 5 more",), (None,)]
    df = spark.createDataFrame(rows, "a string")
    got = [r.p for r in df.select(text.parsed_action(F.col("a")).alias("p")).collect()]
    assert [g and tuple(g) for g in got] == [("split", 5, None), ("merge", 4, 3), ("discard", 228, None), None, None, None]
    loose = [r.p for r in df.select(text.parsed_action(F.col("a"), strict=False).alias("p")).collect()]
    assert tuple(loose[4]) == ("split", 5, None)


def test_json_reading_is_tolerant(spark):
    cases = {
        'x ```json\n{"a": {"b": "}"}, // c\n}```': '{"a":{"b":"}"}}',
        '{"u": "http://x/y, ]", "v": [1, 2,], } and {"u": 1}': '{"u":"http://x/y, ]","v":[1,2]}',
        'say "so: {"a": "\\"//", // it"s\n "b": 1}': '{"a":"\\"//","b":1}',
        "{never": None,
        "{not} json": None,
        "no object": None,
        "": None,
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.j for r in df.select("t", text.json_object(F.col("t")).alias("j")).collect()}
    assert got == cases


def test_actions_of_answers(spark):
    cases = {
        " keep\n": "KEEP",
        '{"action": "split", "see": "http://a//b"}': "SPLIT",
        "Well.\r\nAction : discard now": "DISCARD",
        "< action >KEEP</ action>": "KEEP",
        "Action: MERGE\nfinal answer: keep": "INVALID_ACTION",
        "FINAL ANSWER: MERGE": "INVALID_ACTION",
        "So.\n  SPLIT \n1.": "SPLIT",
        "x\n  SPLIT \ny": "INVALID_ACTION",
        "maybe keep, maybe not": "INVALID_ACTION",
        "keep it" + "\nline" * 8: "PARSE_ERROR",
        "": "PARSE_ERROR",
        None: "PARSE_ERROR",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.a for r in df.select("t", text.extracted_action(F.col("t"), ["KEEP", "DISCARD", "SPLIT"]).alias("a")).collect()}
    assert got == cases


def test_interval_cutoff_is_a_distribution_quantile():
    f, cutoff = extras.interval_cutoff(0.002, 0.0, 0.05)
    assert math.isclose(f, 0.04) and 0 < cutoff < 2


def test_samples_are_even(spark):
    rows = spark.range(101).withColumn("g", F.lit(1))
    assert sorted(r.id for r in datasets.systematic_sample(rows, ["g"], "id", 5).collect()) == [0, 25, 50, 75, 100]
    assert datasets.sampled_split(list("abcd"), 2, 1, 3) == datasets.sampled_split(list("dcba"), 2, 1, 3)
    with pytest.raises(ValueError):
        datasets.sampled_split(["a"], 1, 1, 0)


def test_fallback_when_all_pairs_are_known(spark):
    pairs = spark.createDataFrame([(1, 2), (3, 4)], "a int, b int")
    assert matching.not_among(pairs, pairs, ["a", "b"], pairs).count() == 2
    assert matching.not_among(pairs, pairs.limit(1), ["a", "b"], pairs).count() == 1


def test_size_filters(spark):
    rows = [(0, i, 0.0, 1.0, 1 if i < 3 else 2, 1 if i < 3 else 2, 1) for i in range(8)]
    s = spark.createDataFrame(rows, EVENTS)
    assert {r.cl: r.action for r in curation.size_filter(s, 4).collect()} == {1: "DISCARD", 2: "KEEP"}
    assert {(r.oc, r.cl) for r in curation.small_fine_labels_cleared(s, 4).collect()} == {(0, 0), (2, 2)}
    assert {r.cl for r in curation.size_filtered(s, 4).collect()} == {0, 2}


def test_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "step int, gt_action string")
    files.write_jsonl(rows, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), "step int, gt_action string").count() == 2
    files.write_csv(rows, str(tmp_path / "c"))
    assert files.read_csv(spark, str(tmp_path / "c"), "step int, gt_action string").where("step = 1").first().gt_action == "a"
    (tmp_path / "d").mkdir()
    np.save(tmp_path / "d" / "spike_times.npy", np.array([30000.0, 60000.0]))
    np.save(tmp_path / "d" / "hierarchy_assigns.npy", np.array([1, 2]))
    got = files.raw_spikes(files.read_arrays(spark, str(tmp_path))).orderBy("spike_id").collect()
    assert [(r.t, r.cl, r.gt) for r in got] == [(1.0, 1, None), (2.0, 2, None)]
    assert files.discovered(spark, str(tmp_path / "d"), ["spike_times.npy", "hierarchy_assigns.npy"]).count() == 1
    (tmp_path / "r.txt").write_text("precision: 0.5\ntotal: 3\nF1: 0.37 ± 0.12\n")
    assert files.read_report(spark, str(tmp_path / "r.txt")).first()["values"] == {"precision": 0.5, "total": 3.0}
    line = text.mean_std_lines(spark.read.text(str(tmp_path / "r.txt"))).first()
    assert tuple(line) == ("F1", 0.37, 0.12)
    merged = files.settings(spark, {"a": {"x": 1, "y": 2}}, {"a": {"y": 3}, "b": 4}).first().asDict()
    assert merged == {"a_x": 1, "a_y": 3, "b": 4}
    assert "| 1 | a |" in files.markdown(rows)
    with pytest.raises(ValueError, match="more than 1 rows"):
        files.markdown(rows.unionAll(rows), limit=1)
    both = files.with_all_columns(rows, spark.createDataFrame([("z",)], "note string"))
    assert both.where("note = 'z'").first().gt_action == ""
    files.write_once(rows, str(tmp_path / "p"))
    files.write_once(rows.limit(1), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_empty_tables(spark):
    empty = spark.createDataFrame([], EVENTS)
    assert units.unit_quality(empty, 1.0).count() == 0 and matching.best_matches(empty).count() == 0
    assert units.feature_summary(units.unit_features(empty, 1.0, 2.0), ["own_rate"]).first().mean_own_rate == 0.0


def test_stream_memory(spark, tmp_path):
    from curaspark.streaming.memory import answered

    schema = "session string, seq long, phase string, template array<double>, features array<double>, gt_action string, gt_reasoning string"
    spark.createDataFrame([("s", i, "p", [1.0, float(i)], [1.0], "KEEP", "r") for i in range(3)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = answered(stream, str(tmp_path / "memory"), str(tmp_path / "answers"), str(tmp_path / "check"), 1)
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "answers")).count() == 2


def test_flat_and_nulls(spark):
    rows = spark.sql("SELECT 1 AS id, struct(2 AS n, CAST(NULL AS DOUBLE) AS d) AS metrics, CAST(NULL AS STRING) AS s")
    got = datasets.without_nulls(datasets.flat(rows, ["metrics"])).first()
    assert got.metrics_n == 2 and math.isnan(got.metrics_d) and got.s == "" and got.metrics_json == '{"n":2}'


def test_principal_components_match_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 5)) * [5, 3, 1, 1, 1]
    waves = spark.createDataFrame([(0, 1, i, r.tolist()) for i, r in enumerate(x)], "channel_id long, cl long, spike_id long, wf array<double>")
    got = np.array([r.scores for r in extras.principal_components(waves).orderBy("spike_id").collect()])
    c = x - x.mean(0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-6)


def channel():
    counts = pd.DataFrame({"oc": [1, 2, 3, 4, 5], "gt": [1, 2, 1, 0, 2], "n": [100, 90, 8, 30, 5]})
    return state.Session(counts, {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}, [(1, 2, 0.9)])


def test_phases_in_order():
    s = channel()
    log = pipelines.run_phases(s, pipelines.by_purity(0.8), pipelines.by_dominant(), least=6, large=50, final=10)
    assert log == [("Phase0", 5, None, "DISCARD"), ("Phase1", 1, 2, "SPLIT"), ("Phase1", 1, None, "KEEP"), ("Phase1", 2, None, "KEEP"), ("Phase1", 3, None, "KEEP"), ("Phase1", 4, None, "DISCARD"), ("Phase2", 3, 1, "MERGE")]
    assert s.active() == [1, 2] and s.size(1) == 108


def test_small_clusters_go_without_a_large_one():
    s = channel()
    log = pipelines.run_phases(s, lambda *_: "KEEP", lambda *_: "NOT_MERGE", least=1, large=1000, final=1)
    assert [x[3] for x in log if x[0] == "Phase2"] == ["DISCARD"] * 4 and not s.active()


def test_sheets_skip_what_is_gone():
    s = channel()
    got = pipelines.replay_sheet(s, [("split", 1, None), ("discard", 4, None), ("discard", 4, None), ("merge", 3, 1), ("split", 2, None)])
    assert [g[4] for g in got] == [True, True, False, True, False] and s.active() == [1, 2, 5]


def test_students_are_scored_under_forcing():
    got = pipelines.evaluate_student(channel(), lambda s, c: "KEEP")
    assert [(g[2], g[4]) for g in got] == [(1, "SPLIT"), (3, "MERGE"), (4, "DISCARD"), (5, "MERGE"), (2, "KEEP")]


def test_prompts_and_bounds(spark):
    row = spark.range(1).select(
        text.cluster_prompt(F.lit(12), F.lit(0.25), F.lit(0.5), F.lit(3)).alias("a"),
        text.merge_prompt(F.lit(1), F.lit(2), F.lit(0.5), F.lit(0.0)).alias("b"),
        text.criteria(F.lit("STRICT")).alias("c"),
        text.criteria(F.lit("other")).alias("d"),
    ).first()
    assert "12 events: 0.2500" in row.a and "correlate at 0.5000" in row.b
    assert row.c == text.CRITERIA["strict"] and row.d == text.CRITERIA["balanced"]
    assert [r.id for r in datasets.within_bounds(spark.range(10), "id", 2, 3, 10).collect()] == [2, 3, 4, 5, 6]


def test_sliced_intervals_are_the_same(spark):
    rng = np.random.default_rng(3)
    rows = [(0, i, float(t), 1.0, 1, int(c), 1) for i, (t, c) in enumerate(zip(rng.integers(0, 400, 200), rng.integers(1, 4, 200), strict=True))]
    s = spark.createDataFrame(rows, EVENTS)
    whole, sliced = (units.intervals(s, units.UNIT, x).groupBy("cl").agg(F.sort_array(F.collect_list("isi")).alias("i"), F.count("*").alias("n")) for x in (None, 7.0))
    assert {r.cl: (r.i, r.n) for r in whole.collect()} == {r.cl: (r.i, r.n) for r in sliced.collect()}
    a, b = (units.unit_quality(s, 2.0, 60.0, x).orderBy("cl").collect() for x in (None, 7.0))
    assert a == b


def test_interval_quality_matches_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(0, i, float(t), 1.0, 1, int(c), 1) for i, (t, c) in enumerate(zip(rng.random(300) * 40, rng.integers(1, 3, 300), strict=True))]
    s = spark.createDataFrame(rows, EVENTS)
    fs, tref, tmax = 50.0, 0.1, 1.0
    got = extras.interval_quality(s, spark.createDataFrame([(0, 1, 2)], "channel_id long, a long, b long"), fs, tref, 0.0, tmax).first()
    bins = np.linspace(0, tmax, int(tmax * fs))
    step, last = bins[1], int((bins <= tref).sum()) - 1
    times = {c: np.sort([r[2] for r in rows if c in (0, r[5])]) for c in (0, 1, 2)}
    cdf, n = {}, {}
    for c, t in times.items():
        isi = np.diff(t)
        isi = isi[isi < tmax]
        hist = np.bincount(np.minimum(len(bins) - 1, np.floor(isi / step + 0.5).astype(int)), minlength=len(bins))
        n[c], cdf[c] = max(1, hist.sum()), hist.cumsum() / max(1, hist.sum())
    f, cutoff = extras.interval_cutoff(tref, 0.0, tmax)
    for c, d, score in ((1, got.d_first, got.score_first), (2, got.d_second, got.score_second)):
        want = np.sqrt(n[c] * n[0] / (n[c] + n[0])) * (cdf[0] - cdf[c])[: last + 1].max()
        assert math.isclose(d, max(0, want), abs_tol=1e-9) and math.isclose(score, cdf[c][last] / f)
    assert got.allow == (max(got.d_first, got.d_second) <= cutoff)


def test_shapes_of_forests(spark):
    tree = spark.createDataFrame([(0, 0, 1, 2, 0.9), (0, 1, 1, 3, 0.5), (0, 2, 11, 12, 0.8)], "channel_id long, step int, dst long, src long, similarity double")
    members = [(0, 1, oc) for oc in (1, 2, 3)] + [(0, 2, oc) for oc in (11, 12, 13)] + [(0, 3, 20)]
    got = {r.cl: r for r in state.forest(tree, spark.createDataFrame(members, "channel_id long, cl long, oc long")).collect()}
    assert (got[1].kind, got[1].n_merges, got[1].n_roots) == ("complete", 2, 1) and math.isclose(got[1].height, 0.6)
    assert (got[2].kind, got[2].n_roots) == ("partial", 2) and (got[3].kind, got[3].n_merges) == ("flat", 0)


def test_fixed_decimals(spark):
    df = spark.createDataFrame([(1234567.89126,), (-0.5,), (None,)], "x double")
    assert [r.t for r in df.select(files.fixed(F.col("x")).alias("t")).collect()] == ["1234567.8913", "-0.5000", None]


def test_prices_of_the_longest_prefix(spark):
    prices = spark.createDataFrame([("big", 1.0), ("big-mini", 2.0), ("bi", 9.0)], "key string, price double")
    rows = spark.createDataFrame([(1, "BIG-mini-x"), (2, "big-max"), (3, "bigger"), (4, None), (1, "BIG-mini-x")], "i long, model string")
    got = sorted((r.i, r.pricing_key, r.price) for r in matching.prefix_priced(rows, prices).collect())
    assert got == [(1, "big-mini", 2.0), (1, "big-mini", 2.0), (2, "big", 1.0), (3, None, None), (4, None, None)]
