"""The registered queries of this subpackage; each reads its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curaspark.llm import extract, hostrules, jpeg, minhash, packing, pieces, rulefit, substring, urlfilter, warc
from curaspark.llm.common import table
from curaspark.llm.oracles import ORACLE  # noqa: F401  (registered with the queries)


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extracted(table(spark, sf_dir, "pages"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.Archive.write(table(spark, sf_dir, "pages"), min_bytes=0).index()


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rulefit.scored(docs, rulefit.trained(docs, table(spark, sf_dir, "labels")))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages"), URL_RULES)


def op5_hostrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.judged(table(spark, sf_dir, "documents"), host="source")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.repeated_substrings_cut(table(spark, sf_dir, "documents"), window=50)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_digests(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, percent=80)


QUERIES = {
    "op1_html": op1_html,
    "op2_warc": op2_warc,
    "op3_quality": op3_quality,
    "op4_urls": op4_urls,
    "op5_hostrules": op5_hostrules,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_substring": op7_substring,
    "op8_media": op8_media,
    "op9_packing": op9_packing,
    "op10_minhash": op10_minhash,
}
