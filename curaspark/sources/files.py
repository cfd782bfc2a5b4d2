"""Readers and writers of the file formats curation runs exchange."""

from __future__ import annotations

import copy
import io
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Schemas of the files, as DDL.
STEPS = "step INT, channel_id STRING, setting_id STRING, cluster_id BIGINT, action_phase STRING, target_id BIGINT, gt_action STRING, gt_reasoning STRING, student_action STRING, student_rationale STRING, student_model STRING, teacher_feedback STRING, teacher_model STRING, image_paths ARRAY<STRING>, n_spikes BIGINT, n_active_clusters INT"
ACTION_SHEET = "Actions STRING, `Action Reasoning` STRING"
QUALITY = "cluster_id BIGINT, n_spikes BIGINT, firing_rate DOUBLE, isi_violations_rate DOUBLE, isi_violations_count BIGINT, presence_ratio DOUBLE, amplitude_median DOUBLE, amplitude_cv DOUBLE, amplitude_cutoff DOUBLE, snr DOUBLE"
MEMORY = "channel_id STRING, step INT, phase STRING, cluster_id BIGINT, target_id BIGINT, waveform_template ARRAY<FLOAT>, n_spikes BIGINT, isi_rate DOUBLE, amplitude_stats MAP<STRING, DOUBLE>, waveform_corr DOUBLE, merged_isi_rate DOUBLE, gt_action STRING, gt_reasoning STRING, prompt_text STRING, image_paths ARRAY<STRING>, feature_vector ARRAY<FLOAT>"


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, rows: int | None = None) -> DataFrame:
    """Lines of JSON under a schema, blank lines skipped; the first `rows` if given."""
    lines = spark.read.text(path).where(F.length(F.btrim("value")) > 0)
    parsed = lines.select(F.from_json("value", schema if isinstance(schema, str) else schema.simpleString()).alias("r")).select("r.*")
    return parsed.limit(rows) if rows is not None else parsed


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_once(rows: DataFrame, path: str) -> None:
    """Writes parquet unless the path is there already."""
    rows.write.mode("ignore").parquet(path)


def with_all_columns(*frames: DataFrame) -> DataFrame:
    """Rows of all frames under the union of their columns, text blanks for what a frame lacks."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out.na.fill("")


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """`.npy` files under a path, each a row: path, shape, values as doubles in C order."""
    import numpy as np
    import pandas as pd

    def load(batches):
        for batch in batches:
            arrays = [np.load(io.BytesIO(c), allow_pickle=False) for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "shape": [list(a.shape) for a in arrays], "values": [a.astype(float).ravel() for a in arrays]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(load, "path string, shape array<long>, values array<double>")


def raw_spikes(arrays: DataFrame, fs: float = 30000.0) -> DataFrame:
    """Events from directories of arrays: spike_times (samples) with overcluster, hierarchy and true labels; absent ones null."""
    named = arrays.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("channel"), F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("name"), "values")
    wide = named.groupBy("channel").pivot("name", ["spike_times", "overcluster_assigns", "hierarchy_assigns", "gt_assigns"]).agg(F.first("values"))
    at = lambda c: F.get(F.col(c), F.col("i")).cast("bigint")
    rows = wide.select("channel", F.posexplode("spike_times").alias("i", "sample"), "overcluster_assigns", "hierarchy_assigns", "gt_assigns")
    return rows.select("channel", F.col("i").cast("bigint").alias("spike_id"), (F.col("sample") / fs).alias("t"), at("overcluster_assigns").alias("oc"), at("hierarchy_assigns").alias("cl"), at("gt_assigns").alias("gt"))


def read_mat(spark: SparkSession, path: str) -> DataFrame:
    """Events of a MATLAB file (either generation); needs h5py or scipy, which are optional."""
    import numpy as np

    try:
        import h5py

        with h5py.File(path, "r") as f:
            own = f["spikes"]
            fields = {k: np.array(own[k]).ravel() for k in ("spiketimes",)} | {k: np.array(own[p][q]).ravel() for k, p, q in (("oc", "overcluster", "assigns"), ("cl", "hierarchy", "assigns"))}
    except (ImportError, OSError):
        try:
            from scipy.io import loadmat
        except ImportError as e:
            raise ImportError("reading MATLAB files needs h5py or scipy") from e
        own = loadmat(path, squeeze_me=True, struct_as_record=False)["spikes"]
        fields = {"spiketimes": np.ravel(own.spiketimes), "oc": np.ravel(own.overcluster.assigns), "cl": np.ravel(own.hierarchy.assigns)}
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"spike_id": range(len(fields["spiketimes"])), "t": fields["spiketimes"].astype(float), "oc": fields["oc"].astype("int64"), "cl": fields["cl"].astype("int64")}))


def deep_merged(base: dict, over: dict) -> dict:
    """`over` laid on `base`, dicts within dicts; neither is changed."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = deep_merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def settings(spark: SparkSession, *levels: dict) -> DataFrame:
    """One row of a layered configuration, later levels first, nested names joined by '_'."""
    merged: dict = {}
    for level in levels:
        merged = deep_merged(merged, level)

    def leaves(d: dict, prefix: str = "") -> dict:
        out = {}
        for k, v in d.items():
            out |= leaves(v, f"{prefix}{k}_") if isinstance(v, dict) else {f"{prefix}{k}": v if isinstance(v, (int, float, str, bool)) or v is None else json.dumps(v)}
        return out

    return spark.createDataFrame([leaves(merged)])


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Reports of lines `key: value`, one row a file: numbers with a point as doubles, others as integers, in a map of doubles."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.split("value", ":", 2).alias("kv"))
    pairs = lines.where(F.size("kv") == 2).select("file", F.btrim(F.get("kv", F.lit(0))).alias("k"), F.btrim(F.get("kv", F.lit(1))).try_cast("double").alias("v")).where("v is not null")
    return pairs.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("values"))  # a report's lines


def discovered(spark: SparkSession, root: str, required: list[str]) -> DataFrame:
    """Directories under `root` that hold all required files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    parts = files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("dir"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    found = parts.where(F.col("name").isin(required)).groupBy("dir").agg(F.count_distinct("name").alias("n"))
    return found.where(F.col("n") == len(set(required))).select("dir")


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A short table as markdown; one of more than `limit` rows is refused, not cut."""
    got = rows.limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"more than {limit} rows")
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in got)])


def write_text(text: str, path: str) -> None:
    Path(path).write_text(text)


def fixed(c: Column, digits: int = 4) -> Column:
    """Plain decimals without separators of thousands; null stays null."""
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", c.cast("double")))
