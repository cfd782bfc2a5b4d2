"""Projection and interval-quality measures."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.operators import trains
from curaspark.operators.units import UNIT


def principal_components(waves: DataFrame, k: int = 2) -> DataFrame:
    """Scores of mean-removed waveforms on their first k principal components.

    The Gram matrix of a waveform's samples (its length squared) is summed in the engine; its eigenvectors are taken on
    the driver and go back as constants. Signs are fixed so that each component's largest weight is positive.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    n = waves.select(F.max(F.size("wf"))).first()[0] or 0
    if not n:
        return waves.select(*UNIT, "spike_id").withColumn("scores", F.array().cast("array<double>"))
    means = waves.select([F.avg(F.get("wf", F.lit(i))).alias(str(i)) for i in range(n)]).first()
    mean = F.array(*(F.lit(float(m)) for m in means))
    rows = waves.withColumn("v", array_to_vector(F.zip_with("wf", mean, lambda x, m: x - m)))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(rows)
    weights = model.pc.toArray()
    signs = [1.0 if weights[np.abs(weights[:, i]).argmax(), i] >= 0 else -1.0 for i in range(k)]
    score = F.zip_with(vector_to_array("p"), F.array(*(F.lit(s) for s in signs)), lambda x, s: x * s)
    return model.transform(rows).select(*UNIT, "spike_id", score.alias("scores"))


def interval_cutoff(tref: float, tmin: float, tmax: float, level: float = 0.95) -> tuple[float, float]:
    """Fraction of the range below tref, and the largest deviation of interval distributions that chance explains."""
    f = (tref - tmin) / (tmax - tmin)
    spread = math.sqrt(2 * f * (1 - f))
    last = 0.0
    for i in range(201):
        x = i / 100
        share = 0.5 * (1 + math.erf(x / spread)) - 0.5 * math.exp(-2 * x * x) * (1 - math.erf((1 - 2 * f) * x / spread))
        if share < level:
            last = x
    return f, last


def interval_quality(spikes: DataFrame, pairs: DataFrame, fs: float, tref: float, tmin: float, tmax: float) -> DataFrame:
    """Whether the intervals of two clusters may belong to one: statistics of each against both, their scores, allow.

    Distributions of intervals below tmax, of each cluster of a pair (channel_id, a, b) and of both together, are
    compared below tref. A statistic is the greatest scaled excess of the joint distribution, at least 0; a score is
    the share of intervals below tref over the share of the range.
    """
    f, cutoff = interval_cutoff(tref, tmin, tmax)
    step = tmax / (max(2, math.floor(tmax * fs)) - 1)
    last = math.floor(tref / step + 1e-9)

    def classify(gap: np.ndarray) -> np.ndarray:
        slot = np.floor(np.where(gap < tmax, gap, 0.0) / step + 0.5)
        return np.where(gap < tmax, np.minimum(slot, last + 1), last + 2).astype(np.int64)

    reach = [min(tmax, (i + 0.5) * step) for i in range(last + 1)] + [tmax]
    got = trains.gap_classes(spikes, pairs, classify, reach).where(F.exists("joint", lambda x: x > 0))
    names = ("first", "second", "joint")
    sums = [sum((F.get(w, F.lit(j)) for j in range(1, i + 1)), F.get(w, F.lit(0))).alias(f"{w}_{i}") for w in names for i in range(last + 2)]
    rows = got.select("channel_id", "a", "b", *sums)
    n = {w: F.greatest(F.lit(1), F.col(f"{w}_{last + 1}")) for w in names}
    share = {w: [F.col(f"{w}_{i}") / n[w] for i in range(last + 1)] for w in names}

    def statistic(w: str):
        size = F.sqrt(n[w] * n["joint"] / (n[w] + n["joint"]))
        return F.greatest(F.lit(0.0), *(size * (x - y) for x, y in zip(share["joint"], share[w], strict=True)))

    got = rows.select("channel_id", "a", "b", statistic("first").alias("d_first"), statistic("second").alias("d_second"), *((share[w][last] / f).alias(f"score_{w}") for w in names))
    return got.withColumn("allow", (F.col("d_first") <= cutoff) & (F.col("d_second") <= cutoff))
