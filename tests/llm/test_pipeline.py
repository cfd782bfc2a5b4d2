"""The corpus pipeline, stage by stage against plain Python."""

import __spark_entry__
import pytest
from pyspark.sql import functions as F
from test_ops import DOCS, ODD, brute_components, counts, cut

import corpus_pipeline
from curaspark.llm import rulefit
from curaspark.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root, docs, out = tmp_path_factory.mktemp("stages"), table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(root / name))
        before, docs = docs, spark.read.parquet(str(root / name))
        out.append((name, before, docs))
    return {name: (before, after) for name, before, after in out}


def test_columns_stay(stages):
    for name, (before, after) in stages.items():
        if name != "best_fit_packing":
            assert after.columns == before.columns and dict(after.dtypes) == dict(before.dtypes)


def test_rules_reject_what_fails(stages):
    before, after = stages["quality_rules"]
    want = {r.doc_id for r in before.collect() if (c := counts(r.text))[0] >= 50 and 2 * c[4] <= c[0]}
    assert {r.doc_id for r in after.collect()} == want


def test_classifier_rejects_low_scores(spark, stages):
    before, after = stages["quality_classifier"]
    model = rulefit.trained(before, table(spark, SF, "labels"))
    want = {r.doc_id for r in rulefit.scored(before, model).collect() if r.predicted}
    assert {r.doc_id for r in after.collect()} == want


def test_one_of_each_group_stays(stages):
    before, after = stages["near_dedup"]
    comps, _ = brute_components([(r.doc_id, r.text) for r in before.collect()], 5)
    assert {r.doc_id for r in after.collect()} == {i for i, c in comps.items() if i == c}


def test_passages_are_cut(stages):
    before, after = stages["substring_dedup"]
    texts = {r.doc_id: r.text for r in before.collect()}
    want = {i: (t if gone else texts[i]) for i, _, gone, t in cut(list(texts.items()), 50)}
    got = after.collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_run_equals_its_stages(spark, stages):
    _, after = stages["best_fit_packing"]
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    got = __spark_entry__.queries()["pipeline"](spark, SF)
    assert sorted(tuple(r[k] for k in key) for r in got.collect()) == sorted(tuple(r[k] for k in key) for r in after.collect())


def test_odd_tables(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert got.count() <= len(ODD) or name == "best_fit_packing"
        assert stage(spark, docs.limit(0), SF).count() == 0, name


CLASHING = ("_kept", "kept", "kept_id", "text.b", "row", "tag", "host", "score", "found", "n_words", "a b", "rep", "key", "label", "quality", "v")


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_extra_columns_with_clashing_names_stay(spark, name, stage):
    docs = spark.createDataFrame(ODD, DOCS)
    for c in CLASHING:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    got = stage(spark, docs, SF)
    if name == "best_fit_packing":
        assert {r.doc_id for r in got.collect()} == {r[0] for r in ODD}
        return
    assert got.columns == docs.columns
    for r in got.collect():
        assert all(r[c] == f"{c}:{'none' if r.doc_id is None else r.doc_id}" for c in CLASHING)
