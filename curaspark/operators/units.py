"""Quality metrics of clusters of events.

Everything is keyed by (channel_id, cl), so a plan shuffles events once on that key; the lag window and the aggregates
above it share the partitioning. Waveforms are exploded only where a metric needs single samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curaspark.functions import arrays

UNIT = ["channel_id", "cl"]


def intervals(spikes: DataFrame, by: list[str] = UNIT, slice_seconds: float | None = None) -> DataFrame:
    """Adds `isi`, the time since the previous event of the same group.

    With `slice_seconds` a group is cut into slices of time, so that one with a large share of all events spreads over
    tasks: lags are taken within slices, and the first event of a slice looks at the last of the slice before it, of
    which there is one short row each.
    """
    if slice_seconds is None:
        return spikes.withColumn("isi", F.col("t") - F.lag("t").over(Window.partitionBy(*by).orderBy("t")))
    keys = [*by, "_slice"]
    rows = spikes.withColumn("_slice", F.floor(F.col("t") / slice_seconds))
    ends = rows.groupBy(*keys).agg(F.max("t").alias("_end"))
    ends = ends.withColumn("_end", F.lag("_end").over(Window.partitionBy(*by).orderBy("_slice")))
    previous = F.coalesce(F.lag("t").over(Window.partitionBy(*keys).orderBy("t")), F.col("_end"))
    return rows.join(ends, keys).withColumn("isi", F.col("t") - previous).drop("_slice", "_end")


def _ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(default))


def violations(tref: float) -> Column:
    return F.count_if(F.col("isi") < tref)


def interval_violations(spikes: DataFrame, tref: float, by: list[str] = UNIT) -> DataFrame:
    """n, strict violations of the refractory time, and rates over n - 1, over n, and with the first event doubled."""
    got = intervals(spikes, by).groupBy(*by).agg(F.count("*").alias("n_spikes"), violations(tref).alias("n_violations"))
    n, v = F.col("n_spikes"), F.col("n_violations")
    return got.select(*by, "n_spikes", "n_violations", _ratio(v.cast("double"), n - 1).alias("rate"), _ratio(v.cast("double"), n).alias("rate_by_n"), _ratio((v + 1).cast("double"), n).alias("self_rate"))


def unit_quality(spikes: DataFrame, tref: float, bin_seconds: float = 60.0, slice_seconds: float | None = None) -> DataFrame:
    """Count, rate over the channel's span, interval violations, presence, and spread of amplitudes, per cluster.

    Presence counts distinct bins of absolute time against the bins of the channel's duration; 0 below two events.
    """
    got = intervals(spikes, UNIT, slice_seconds).groupBy(*UNIT).agg(
        F.count("*").alias("n_spikes"),
        F.min("t").alias("first_t"),
        F.max("t").alias("last_t"),
        violations(tref).alias("isi_violations_count"),
        F.count_distinct(F.floor(F.col("t") / bin_seconds)).alias("bins"),
        F.median("amp").alias("amplitude_median"),
        F.avg("amp").alias("mean_amp"),
        F.stddev_pop("amp").alias("std_amp"),
    )
    channel = Window.partitionBy("channel_id")  # over clusters, not events
    got = got.withColumn("duration", F.max("last_t").over(channel) - F.min("first_t").over(channel)).withColumn("channel_n", F.sum("n_spikes").over(channel))
    n = F.col("n_spikes")
    rate = F.when((F.col("channel_n") > 1) & (F.col("duration") > 0), n / F.when(F.col("duration") > 0, F.col("duration"))).otherwise(1.0)
    presence = F.when(n < 2, 0.0).otherwise(_ratio(F.col("bins").cast("double"), F.ceil(F.col("duration") / bin_seconds)))
    return got.select(
        *UNIT,
        "n_spikes",
        rate.alias("firing_rate"),
        _ratio(F.col("isi_violations_count").cast("double"), n - 1).alias("isi_violations_rate"),
        "isi_violations_count",
        presence.alias("presence_ratio"),
        "amplitude_median",
        _ratio(F.col("std_amp"), F.col("mean_amp")).alias("amplitude_cv"),
    )


def unit_features(spikes: DataFrame, tref: float, window: float) -> DataFrame:
    """Rate over the cluster's own span, interval quality within `window`, sample CV of amplitudes, fine labels."""
    got = intervals(spikes).groupBy(*UNIT).agg(
        F.count("*").alias("n_spikes"),
        (F.max("t") - F.min("t")).alias("span"),
        F.count_if((F.col("isi") > 0) & (F.col("isi") <= window)).alias("short"),
        F.count_if((F.col("isi") > 0) & (F.col("isi") <= window) & (F.col("isi") < tref)).alias("bad"),
        F.avg("amp").alias("mean_amp"),
        F.coalesce(F.stddev_samp("amp"), F.lit(0.0)).alias("std_amp"),
        F.count_distinct("oc").alias("n_overclusters"),
    )
    quality = F.when(F.col("short") > 0, 1 - F.col("bad") / F.when(F.col("short") > 0, F.col("short"))).otherwise(1.0)
    return got.select(*UNIT, "n_spikes", _ratio(F.col("n_spikes").cast("double"), F.col("span")).alias("own_rate"), quality.alias("isi_quality"), F.col("mean_amp").alias("amplitude_mean"), F.col("std_amp").alias("amplitude_std"), _ratio(F.col("std_amp"), F.col("mean_amp")).alias("amplitude_cv"), "n_overclusters")


def feature_summary(features: DataFrame, columns: list[str]) -> DataFrame:
    """Means over clusters, 0 for an empty table, and the number of clusters."""
    return features.agg(F.count("*").alias("n_clusters"), *(F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in columns))


def interval_histogram(spikes: DataFrame, width: float, limit: float) -> DataFrame:
    """Counts of intervals below `limit` in bins of `width`; the last edge is the last multiple below `limit`, closed."""
    last = limit - width
    bin_ = F.least(F.floor(F.col("isi") / width), F.lit(round(last / width) - 1)).cast("bigint")
    return intervals(spikes).where(F.col("isi").isNotNull() & (F.col("isi") < limit) & (F.col("isi") <= last)).groupBy(*UNIT, bin_.alias("bin")).agg(F.count("*").alias("n"))


def amplitude_histogram(spikes: DataFrame, bins: int = 50) -> DataFrame:
    """Counts of amplitudes of each cluster in equal bins between its least and greatest, empty bins left out."""
    edges = spikes.groupBy(*UNIT).agg(F.min("amp").alias("low"), F.max("amp").alias("high"))
    return spikes.join(edges, UNIT).groupBy(*UNIT, arrays.equal_bins(F.col("amp"), F.col("low"), F.col("high"), bins).alias("bin")).agg(F.count("*").alias("n"))


def amplitude_cutoff(spikes: DataFrame, bins: int = 500) -> DataFrame:
    """Share of a cluster's amplitudes in bins below the first fullest bin; 0 if that is the last bin."""
    counts = amplitude_histogram(spikes, bins)
    peak = counts.groupBy(*UNIT).agg(F.sum("n").alias("total"), F.max(F.struct(F.col("n").alias("n"), (-F.col("bin")).alias("b"))).alias("top"))
    below = counts.join(peak, UNIT).groupBy(*UNIT).agg(F.max(-F.col("top.b")).alias("peak"), F.sum(F.when(F.col("bin") < -F.col("top.b"), F.col("n")).otherwise(0)).alias("below"), F.max("total").alias("total"))
    return below.select(*UNIT, F.col("peak").cast("int").alias("peak_bin"), F.when(F.col("peak") == bins - 1, 0.0).otherwise(F.col("below") / F.col("total")).alias("amplitude_cutoff"))


def rate_histogram(spikes: DataFrame, bins: int = 10) -> DataFrame:
    """Events of each cluster by the nearest of `bins` centres spread over the channel's time."""
    span = spikes.groupBy("channel_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    step = (F.col("t1") - F.col("t0")) / bins
    bin_ = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("t") - F.col("t0")) / F.when(step > 0, step) + 0.5)))
    return spikes.join(span, "channel_id").groupBy(*UNIT, F.coalesce(bin_, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def presence_by_bin(spikes: DataFrame, bin_seconds: float) -> DataFrame:
    return spikes.groupBy(*UNIT, F.floor(F.col("t") / bin_seconds).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def samples(waves: DataFrame) -> DataFrame:
    return waves.select(*UNIT, "spike_id", F.posexplode("wf").alias("i", "x"))


def templates(waves: DataFrame, how: str = "median") -> DataFrame:
    """Per cluster: count and the pointwise median or mean waveform as an array."""
    value = F.median("x") if how == "median" else F.avg("x")
    points = samples(waves).groupBy(*UNIT, "i").agg(value.alias("x"), F.count("*").alias("n"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"])  # one waveform long
    return points.groupBy(*UNIT).agg(F.max("n").alias("n_spikes"), ordered.alias("template"))


def template_points(waves: DataFrame, how: str = "median") -> DataFrame:
    value = F.median("x") if how == "median" else F.avg("x")
    return samples(waves).groupBy(*UNIT, "i").agg(value.alias("x"))


def signal_to_noise(waves: DataFrame) -> DataFrame:
    """Peak to trough of the median template over the pooled deviation of all samples from it; 0 without noise."""
    points = samples(waves)
    middle = points.groupBy(*UNIT, "i").agg(F.median("x").alias("m"))
    got = points.join(middle, [*UNIT, "i"]).groupBy(*UNIT).agg((F.max("m") - F.min("m")).alias("signal"), F.stddev_pop(F.col("x") - F.col("m")).alias("noise"))
    return got.select(*UNIT, "signal", "noise", _ratio(F.col("signal"), F.col("noise")).alias("snr"))


def correlation_to_mean(waves: DataFrame, limit: int | None = None) -> DataFrame:
    """Mean correlation of a cluster's waveforms with its mean waveform, over all or `limit` of least hash."""
    rows = waves
    if limit is not None:
        rank = F.row_number().over(Window.partitionBy(*UNIT).orderBy(F.xxhash64("spike_id"), "spike_id"))
        rows = waves.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")
    mean = templates(waves, "mean").select(*UNIT, "template")
    return rows.join(mean, UNIT).groupBy(*UNIT).agg(F.avg(arrays.pearson(F.col("wf"), F.col("template"), 0.0)).alias("mean_corr"), F.count("*").alias("n"))


def waveform_summary(waves: DataFrame) -> DataFrame:
    """Per cluster and sample: mean, sample deviation, standard error and the band around the mean."""
    got = samples(waves).groupBy(*UNIT, "i").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.count("*").alias("occupancy"))
    error = F.col("std") / F.sqrt("occupancy")
    return got.select(*UNIT, "i", "mean", "std", error.alias("se"), (F.col("mean") - error).alias("lower"), (F.col("mean") + error).alias("upper"), "occupancy")


def waveform_density(waves: DataFrame, bins: int, log: bool = False) -> DataFrame:
    """Counts of samples by place and value bin, over the range of all values."""
    points = samples(waves)
    edges = points.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    got = points.crossJoin(F.broadcast(edges)).groupBy("i", arrays.equal_bins(F.col("x"), F.col("low"), F.col("high"), bins).alias("bin")).agg(F.count("*").alias("n"))  # edges is one row
    return got.withColumn("n", F.log1p("n")) if log else got


def bad_classes(waves: DataFrame, limit: float, least: int) -> DataFrame:
    """Clusters whose mean waveform reaches `limit` in size or that have fewer than `least` events."""
    got = templates(waves, "mean")
    size = F.array_max(F.transform("template", F.abs))
    return got.select(*UNIT, "n_spikes", size.alias("peak"), ((size >= limit) | (F.col("n_spikes") < least)).alias("bad"))


def peak_to_trough_stats(waves: DataFrame) -> DataFrame:
    """Median, population and sample CV of peak to trough per cluster."""
    got = waves.withColumn("ptp", arrays.peak_to_trough(F.col("wf"))).groupBy(*UNIT).agg(F.count("*").alias("n"), F.median("ptp").alias("ptp_median"), F.avg("ptp").alias("mean"), F.stddev_pop("ptp").alias("sp"), F.coalesce(F.stddev_samp("ptp"), F.lit(0.0)).alias("ss"))
    return got.select(*UNIT, "n", "ptp_median", _ratio(F.col("sp"), F.col("mean")).alias("cv_pop"), _ratio(F.col("ss"), F.col("mean")).alias("cv_samp"))
