"""Pairs of clusters by blocks against counting each pair by itself."""

import itertools

import numpy as np
import pytest

from curaspark.operators import curation, extras, matching, pipelines, trains
from curaspark.plans import unit_queries

EVENTS = "channel_id long, spike_id long, t double, amp double, oc long, cl long, gt long"


@pytest.fixture(scope="module")
def trained(spark):
    """Two channels of nine clusters, many events at one time, a cluster of one event."""
    rng = np.random.default_rng(8)
    rows = [(int(ch), i, float(t), 1.0, 1, int(c), 1) for i, (ch, t, c) in enumerate(zip(rng.integers(0, 2, 500), rng.integers(0, 160, 500) / 2, rng.integers(1, 9, 500), strict=True))]
    rows += [(0, 900, 3.5, 1.0, 1, 9, 1)]
    times = {}
    for ch, _, t, _, _, c, _ in rows:
        times.setdefault((ch, c), []).append(t)
    pairs = [(ch, a, b) for ch in (0, 1) for a, b in itertools.combinations(sorted(c for x, c in times if x == ch), 2)]
    return spark.createDataFrame(rows, EVENTS), spark.createDataFrame(pairs, "channel_id long, a long, b long"), {k: np.sort(v) for k, v in times.items()}, pairs


@pytest.fixture(params=[1 << 20, 3072], ids=["one block", "many blocks"])
def blocks(request, monkeypatch):
    monkeypatch.setattr(trains, "EVENTS", request.param)


def test_merged_intervals_of_all_pairs(trained, blocks):
    s, pairs, times, listed = trained
    df = matching.merged_intervals(s, pairs, 1.0)
    got = {(r.channel_id, r.a, r.b): (r.n_merged, r.merged_isi) for r in df.collect()}
    for ch, a, b in listed:
        t = np.sort(np.concatenate([times[ch, a], times[ch, b]]))
        assert got[ch, a, b] == (len(t), (np.diff(t) < 1.0).sum() / (len(t) - 1))
    assert len(got) == len(listed)
    assert "windowspecdefinition" not in df._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroupsInArrow")[0]


def test_interval_quality_of_all_pairs(trained, blocks):
    s, pairs, times, listed = trained
    fs, tref, tmax = 5.0, 1.0, 6.0
    got = {(r.channel_id, r.a, r.b): r for r in extras.interval_quality(s, pairs, fs, tref, 0.0, tmax).collect()}
    step = tmax / (int(tmax * fs) - 1)
    last, (f, cutoff) = int(tref / step + 1e-9), extras.interval_cutoff(tref, 0.0, tmax)
    for ch, a, b in listed:
        cdf, n = [], []
        for t in (times[ch, a], times[ch, b], np.sort(np.concatenate([times[ch, a], times[ch, b]]))):
            gaps = np.diff(t)
            gaps = gaps[gaps < tmax]
            n.append(max(1, len(gaps)))
            cdf.append(np.bincount(np.floor(gaps / step + 0.5).astype(int), minlength=last + 1).cumsum()[: last + 1] / n[-1])
        r = got[ch, a, b]
        d = [max(0, np.sqrt(n[i] * n[2] / (n[i] + n[2])) * (cdf[2] - cdf[i]).max()) for i in (0, 1)]
        assert np.allclose([r.d_first, r.d_second, r.score_first, r.score_second, r.score_joint], [*d, *(c[last] / f for c in cdf)])
        assert r.allow == (max(r.d_first, r.d_second) <= cutoff)
    assert len(got) == len(listed)


def test_correlogram_of_all_pairs(spark, trained, blocks):
    s, _, times, listed = trained
    listed = listed + [(ch, c, c) for ch, c in times]
    pairs = spark.createDataFrame(listed, "channel_id long, a long, b long")
    df = matching.cross_correlogram(s, pairs, 4.0, 5)
    got = {(r.channel_id, r.a, r.b, r.lag): r.n for r in df.collect()}
    wanted = [p for p in listed if len(times[p[0], p[1]]) > 1 and len(times[p[0], p[2]]) > 1]
    assert len(got) == 11 * len(wanted)
    for ch, a, b in wanted:
        d = (times[ch, b][None, :] - times[ch, a][:, None]).ravel()
        d = d[np.abs(d) <= 4.0] / 0.8
        lags = np.sign(d) * np.floor(np.abs(d) + 0.5)
        assert [got[ch, a, b, k] for k in range(-5, 6)] == [0 if k == 0 and a == b else int((lags == k).sum()) for k in range(-5, 6)]
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroupsInArrow")[0]


def test_only_best_pairs_are_merged(spark, monkeypatch):
    seen = []
    real = matching.merged_intervals
    monkeypatch.setattr(matching, "merged_intervals", lambda s, p, tref: seen.append(p.count()) or real(s, p, tref))
    rows = [(0, 100 * c + i, float(1000 * c + 10 * i), 1.0, c, c, 1) for c in range(1, 13) for i in range(4 if c < 7 else 9)]
    similarity = [(0, a, b, 0.9 - 0.01 * abs(a + 6 - b)) for a in range(1, 7) for b in range(7, 13)]
    got = pipelines.heuristic_labels(spark.createDataFrame(rows, EVENTS), spark.createDataFrame(similarity, "channel_id long, small long, large long, corr double"), 1.0, 2, 6, 13, most_isi=0.5)
    assert seen == [6]
    assert {r.spike_id: r.cl for r in got.select("spike_id", "cl").collect()} == {r[1]: r[5] + 6 if r[5] < 7 else r[5] for r in rows}


def test_pairs_by_size_keep_the_best(spark):
    sizes = spark.createDataFrame([(0, 1, 5, "small"), (0, 2, 5, "small"), (0, 3, 9, "large"), (0, 4, 9, "large"), (0, 5, 7, "large")], "channel_id long, cl long, n long, size_class string")
    short = matching.least_by_size(sizes)
    assert sorted((r.cl, r.n) for r in short.collect()) == [(1, 5), (2, 5), (3, 9), (5, 7)]
    pairs = matching.small_large_pairs(short).selectExpr("channel_id", "small", "large", "abs(n_large - 8) * -0.1D as corr")
    assert sorted((r.small, r.large) for r in curation.best_by_correlation(pairs).collect()) == [(1, 3), (2, 3)]


def test_correlogram_of_all_clusters_without_listed_pairs(spark, trained, monkeypatch):
    """All pairs are made where their events are: none is joined or shuffled, whatever the blocks, and they are as when listed."""
    s, _, times, _ = trained
    listed = [(ch, a, b) for ch, a in times for x, b in times if x == ch and a <= b]
    wanted = sorted(map(tuple, matching.cross_correlogram(s, spark.createDataFrame(listed, "channel_id long, a long, b long"), 4.0, 5).collect()))
    for events, clusters, step in ((1 << 18, 2048, 1 << 20), (64, 8, 100), (1, 1, 1)):
        monkeypatch.setattr(trains, "ALL_EVENTS", events)
        monkeypatch.setattr(trains, "ALL_CLUSTERS", clusters)
        monkeypatch.setattr(trains, "STEP", step)
        monkeypatch.setattr(trains, "CELLS", step)
        monkeypatch.setattr(trains, "TASKS", 4)
        assert sorted(map(tuple, matching.cross_correlogram(s, None, 4.0, 5).collect())) == wanted


def test_correlogram_query_joins_no_pairs(spark):
    plan = unit_queries.QUERIES["crosscorrelogram"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "FlatMapCoGroupsInArrow" not in plan and "a <=" not in plan


def test_lag_bounds_are_those_of_rounding():
    """Times on, and a rounding error off, the edges of bins, and ties."""
    rng = np.random.default_rng(4)
    for base in (0.0, 1.7e9, -3.0):
        t = np.sort(base + rng.integers(0, 60, 200) / 10)
        u = np.sort(np.concatenate([t[:100] + 0.05, np.nextafter(t + 0.1, -np.inf), np.nextafter(t + 0.1, np.inf), t[::2] - 0.3]))
        distinct, starts = np.unique(u, return_index=True)
        got = trains.lag_bounds(t, distinct, np.append(starts, len(u)), 0.3, 3)
        d = u[None, :] - t[:, None]
        x = d / (0.3 / 3)
        whole = np.trunc(x)
        place = whole + np.where(np.abs(x - whole) >= 0.5, np.sign(x), 0) + 3
        place = np.where(d < -0.3, -1, np.where(d > 0.3, 7, np.clip(place, 0, 6)))
        assert (got == [[int((row < i).sum()) for i in range(8)] for row in place]).all()
