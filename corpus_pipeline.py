"""From raw documents to packed training sequences: five stages, each one operator of curaspark.llm over all its input.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes each stage's result to the shared folder and rereads it, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curaspark.llm import hostrules, minhash, packing, rulefit, substring
from curaspark.llm.common import Store, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the document rules or whose source the host rules reject."""
    return hostrules.kept_documents(docs, host="source")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a quality score below 0.3; the rules are learnt from labels of the documents given."""
    return rulefit.kept_documents(docs, rulefit.trained(docs, table(spark, sf_dir, "labels")), least=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return minhash.one_of_each_group(docs, shingle_words=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that a document of smaller doc_id has too; other texts stay as they are."""
    cut = substring.repeated_substrings_cut(docs, window=50, keep_text=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    own = {"text": text, "n_chars": F.length(text).cast("long")}
    return cut.select(*((own[c] if c in own else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of at most 2048."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Language scores and tokenizer ids are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, docs = Store(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = store.save(stage(spark, docs, sf_dir), name)
        if i:
            store.drop(STAGES[i - 1][0])
    return docs
