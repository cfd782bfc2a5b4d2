"""Document and host quality rules, in DataFrame functions only.

A document fails on its own counts: too few words, or too many words in repeated 3-word windows. Hosts are judged by
their documents: failures are counted by host, the spread of failure rates over hosts gives a beta prior by the method
of moments, each host's rate is shrunk toward it, and a host goes if even the low end of its posterior is over a limit.
Verdicts are joined back to documents by host and a salt of the document, so a host with a third of all rows spreads.

Repeated windows are found without leaving the row: windows are hashed and sorted with their places packed in the low
bits, neighbours of equal hash bits are compared by their words, and nothing is exploded.

Defined results: a null or empty text has no words and fails; a null host is a host of its own; rows that repeat are
judged each; extra columns travel in one struct, so no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.llm.common import WORD_BREAKS, Store

MIN_WORDS, REPEAT_PERCENT = 50, 50
#: A host is rejected if the mean less MARGIN standard deviations of its posterior failure rate exceeds HOST_LIMIT.
HOST_LIMIT, MARGIN = 0.8, 3.0
SALTS = 64
_SYMBOLS = "#*$%&|<>"
_PLACE_BITS = 31  # as large as an array can be; equal bits of other words are told apart by the words


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words_of(text: Column) -> Column:
    """Words of a text that is not null; the empty array if there are none."""
    trimmed = F.btrim(text, F.lit(WORD_BREAKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+"))


def _with_places(rows: DataFrame) -> DataFrame:
    """Adds the places i in `w` whose window of words i, i+1, i+2 occurs at another place too, ascending.

    A step a column, so that no array is computed twice.
    """
    words, low = F.col("w"), (1 << _PLACE_BITS) - 1

    def window(i: Column) -> Column:
        return F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit(low)).cast("int")

    def twin(items: Column, same):
        return lambda x, j: F.coalesce(same(x, F.get(items, j - 1)), F.lit(False)) | F.coalesce(same(x, F.get(items, j + 1)), F.lit(False))

    hashed = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(window(i)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
    rows = rows.withColumn("s", F.when(F.size("w") > 3, F.sort_array(hashed)))
    like = twin(F.col("s"), lambda a, b: F.shiftright(a, _PLACE_BITS) == F.shiftright(b, _PLACE_BITS))
    rows = rows.withColumn("s", F.filter("s", like))
    rows = rows.withColumn("s", F.array_sort(F.transform("s", lambda x: F.struct(window(place(x)).alias("window"), place(x).alias("i")))))
    rows = rows.withColumn("s", F.filter("s", twin(F.col("s"), lambda a, b: a["window"] == b["window"])))
    return rows.withColumn("places", F.sort_array(F.coalesce(F.transform("s", lambda x: x["i"]), F.array().cast("array<int>")))).drop("s")


def _covered(places: Column) -> Column:
    """Number of words under the windows that start at these ascending places."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(places, start, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])


def with_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """row (all columns of `docs`), doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), text.alias("t"))
    rows = _with_places(rows.withColumn("w", words_of(F.col("t"))).withColumn("l", F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(WORD_BREAKS)) != "")))
    return rows.select(
        "row",
        "doc_id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.length(_without(F.col("t"), WORD_BREAKS)).cast("long").alias("word_chars"),
        (F.length("t") - F.length(_without(F.col("t"), _SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("places")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def host_verdicts(judged: DataFrame) -> DataFrame:
    """A row per host: host, n, failed, shrunk rate, and rejected. `judged` has host and base_failed."""
    hosts = judged.groupBy("host").agg(F.count("*").cast("double").alias("n"), F.count_if("base_failed").cast("double").alias("failed"))
    rate = F.col("failed") / F.col("n")
    whole = hosts.agg(F.sum("failed").alias("f"), F.sum("n").alias("m"), F.count("*").cast("double").alias("k"), F.sum(F.col("n") * rate * rate).alias("sq"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    mean = F.col("f") / F.col("m")
    within = mean * (1 - mean)
    # variance between hosts by moments: the weighted variance of rates less what sampling alone gives
    spread = F.try_divide(F.col("sq") / F.col("m") - mean * mean - within * (F.col("k") - 1) / F.col("m"), 1 - F.col("nn") / (F.col("m") * F.col("m")))
    strength = F.least(F.lit(1e6), F.greatest(F.lit(2.0), F.coalesce(F.try_divide(within, spread) - 1, F.lit(1e6))))
    strength = F.when(F.coalesce(spread, F.lit(0.0)) <= 0, F.lit(1e6)).otherwise(strength)
    prior = whole.select((mean * strength).alias("a"), ((1 - mean) * strength).alias("b"))
    both = hosts.crossJoin(F.broadcast(prior))  # one row
    a, b = F.col("a") + F.col("failed"), F.col("b") + F.col("n") - F.col("failed")
    shrunk = F.try_divide(a, a + b)
    sigma = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(a * b, (a + b) * (a + b) * (a + b + 1))))
    return both.select("host", "n", "failed", shrunk.alias("shrunk_rate"), (F.coalesce(shrunk - MARGIN * sigma, F.lit(0.0)) > HOST_LIMIT).alias("rejected"))


def _with_host_verdict(judged: DataFrame, verdicts: DataFrame) -> DataFrame:
    """judged with `rejected`; hosts are spread over salts of the document."""
    salted = verdicts.select(F.coalesce("host", F.lit("")).alias("h"), F.col("host").isNull().alias("hn"), "rejected", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    left = judged.withColumn("h", F.coalesce("host", F.lit(""))).withColumn("hn", F.col("host").isNull()).withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words"), F.lit(SALTS)))
    return left.join(salted, ["h", "hn", "salt"]).drop("h", "hn", "salt")


def _judged(docs: DataFrame, host: str, whole_rows: bool) -> DataFrame:
    """Counts and verdicts; the counts are written once, for the host rates and for the join."""
    store = Store(docs.sparkSession, "hostrules")
    counts = with_counts(docs, host).withColumn("base_failed", base_failed())
    judged = store.save(counts if whole_rows else counts.drop("row"), "counts")
    verdicts = store.save(host_verdicts(judged), "hosts")
    return _with_host_verdict(judged, verdicts).withColumn("kept", ~F.col("base_failed") & ~F.col("rejected"))


def judged(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    return _judged(docs, host, False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def kept_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that pass, with all their columns."""
    return _judged(docs, host, True).where("kept").select("row.*")
