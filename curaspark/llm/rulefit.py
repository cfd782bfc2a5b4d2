"""Quality scores from a sparse rule ensemble over text statistics.

Small regression trees, each grown on a part of a bounded sample of labelled rows, give their paths as conjunctive
rules; a lasso logistic regression keeps few of them and weighs them; the model is then one Spark column expression
over statistics that are themselves column expressions, so scoring runs inside the engine over whole texts.

The sample bound is `SAMPLE` rows (a parameter): those of the least hash of their doc_id, so it never depends on order.
A doc_id that repeats is one row of the sample, with the least statistics of its texts.

Defined results: null and empty texts have statistics of zero and get a score like any text; rows that repeat get a row
each; without labelled rows of both classes every score is the share of label 1 (0.5 without any). doc_id, lang,
source and labels are never inputs of a score. Only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.llm.common import WORD_BREAKS

SAMPLE = 20_000
TREES, DEPTH, BINS, PENALTY = 60, 3, 32, 0.002

STATISTICS = ["words", "word_length", "upper", "digits", "symbols", "pipes", "bangs", "stops", "commas", "distinct", "richness", "same_lines", "line_words"]


def with_statistics(docs: DataFrame) -> DataFrame:
    """`docs` with one double column `s_<name>` for each of STATISTICS, each over the whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def count(characters: str) -> Column:
        out = F.col("_t")
        for c in characters:
            out = F.replace(out, F.lit(c), F.lit(""))
        return F.length("_t") - F.length(out)

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / F.greatest(b, F.lit(1))).otherwise(0.0).cast("double")

    trimmed = F.btrim(F.col("_t"), F.lit(WORD_BREAKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+"))
    rows = docs.withColumn("_t", text).withColumn("_w", words).withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(WORD_BREAKS)) != ""))
    rows = rows.withColumn("_n", F.size("_w")).withColumn("_c", F.length("_t")).withColumn("_d", F.size(F.array_distinct("_w"))).withColumn("_k", F.size("_l"))
    stats = {
        "words": F.log1p(F.col("_n").cast("double")),
        "word_length": share(F.col("_c"), F.col("_n")),
        "upper": share(F.regexp_count("_t", F.lit(r"\p{Lu}")), F.col("_c")),
        "digits": share(F.regexp_count("_t", F.lit("[0-9]")), F.col("_c")),
        "symbols": share(count("#*$%&<>"), F.col("_n")),
        "pipes": share(count("|"), F.col("_n")),
        "bangs": share(count("!"), F.col("_n")),
        "stops": share(count(".?"), F.col("_n")),
        "commas": share(count(","), F.col("_n")),
        "distinct": share(F.col("_d"), F.col("_n")),
        "richness": share(F.col("_d"), F.sqrt(F.col("_n").cast("double"))),
        "same_lines": share(F.col("_k") - F.size(F.array_distinct("_l")), F.col("_k")),
        "line_words": share(F.col("_n"), F.col("_k")),
    }
    return rows.select(*docs.columns, *(stats[s].alias(f"s_{s}") for s in STATISTICS))


Condition = tuple[int, bool, float]  # statistic, whether it must exceed the value, value


@dataclass
class Model:
    intercept: float
    rules: list[tuple[tuple[Condition, ...], float]]

    def score(self) -> Column:
        """The model over columns `s_<statistic>`: a probability of label 1."""
        z = F.lit(float(self.intercept))
        for conditions, weight in self.rules:
            met = F.lit(True)
            for s, above, value in conditions:
                c = F.col(f"s_{STATISTICS[s]}")
                met = met & ((c > value) if above else (c <= value))
            z = z + F.when(met, float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def _grow(x: np.ndarray, y: np.ndarray, edges: list[np.ndarray], codes: np.ndarray, rows: np.ndarray, depth: int, path: tuple[Condition, ...], found: set, least: int) -> None:
    """Splits rows where squared error falls most; every node but the root adds its path."""
    if path:
        found.add(tuple(sorted(path)))
    if depth == 0 or len(rows) < 2 * least:
        return
    target, best = y[rows], (1e-9, None)
    total, n = target.sum(), len(rows)
    for s in range(x.shape[1]):
        if not len(edges[s]):
            continue
        counts = np.bincount(codes[rows, s], minlength=len(edges[s]) + 1).cumsum()[:-1]
        sums = np.bincount(codes[rows, s], target, len(edges[s]) + 1).cumsum()[:-1]
        ok = (counts >= least) & (n - counts >= least)
        gain = np.where(ok, sums**2 / np.maximum(counts, 1) + (total - sums) ** 2 / np.maximum(n - counts, 1) - total**2 / n, 0)
        if gain.max() > best[0]:
            best = gain.max(), (s, int(gain.argmax()))
    if best[1] is None:
        return
    s, cut = best[1]
    low = codes[rows, s] <= cut
    for side, above in ((rows[low], False), (rows[~low], True)):
        _grow(x, y, edges, codes, side, depth - 1, (*path, (s, above, float(edges[s][cut]))), found, least)


def _met(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for s, above, value in rule:
        out &= (x[:, s] > value) if above else (x[:, s] <= value)
    return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, seed: int = 7) -> Model:
    """Rules from boosted trees on random halves, weighed by lasso logistic regression (proximal gradient)."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        edge = min(max(share, 1e-3), 1 - 1e-3) if len(y) else 0.5
        return Model(float(np.log(edge / (1 - edge))), [])
    random = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, s], np.linspace(0, 1, BINS + 1)[1:-1])) for s in range(x.shape[1])]
    edges = [e[e < x[:, s].max()] for s, e in enumerate(edges)]
    codes = np.stack([np.searchsorted(e, x[:, s], side="left") for s, e in enumerate(edges)], axis=1)
    found: set[tuple[Condition, ...]] = set()
    margin = np.full(len(y), np.log(share / (1 - share)))
    for _ in range(trees):
        rows = random.choice(len(y), max(2, len(y) // 2), replace=False)
        residual = y - 1 / (1 + np.exp(-margin))
        own: set[tuple[Condition, ...]] = set()
        _grow(x, residual, edges, codes, rows, depth, (), own, max(5, len(rows) // 500))
        found |= own
        leaves = [r for r in own if not any(set(r) < set(o) for o in own)]
        for rule in leaves:
            met = _met(x, rule)
            if met.any():
                margin[met] += 0.3 * 4 * residual[met].mean()
    rules = sorted(found)
    table = np.stack([_met(x, r) for r in rules], axis=1).astype(np.float64) if rules else np.zeros((len(y), 0))
    _, first = np.unique(table, axis=1, return_index=True) if rules else (None, np.zeros(0, int))
    first.sort()
    rules, table = [rules[i] for i in first], table[:, first]
    weights, intercept = _lasso(table, y.astype(np.float64), penalty)
    return Model(intercept, [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6])


def _lasso(table: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[np.ndarray, float]:
    n, m = table.shape
    full = np.hstack([table - table.mean(0), np.ones((n, 1))])
    size = 4.0
    if m:
        probe = np.ones(m + 1)
        for _ in range(20):
            probe = full.T @ (full @ probe)
            probe /= np.linalg.norm(probe)
        size = 4.0 * n / np.linalg.norm(full @ probe) ** 2
    w = np.zeros(m + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        slope = full.T @ (1 / (1 + np.exp(-full @ ahead)) - y) / n
        new = ahead - size * slope
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - size * penalty, 0)
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / u * (new - w), new, u
    return w[:-1], float(w[-1] - table.mean(0) @ w[:-1])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of `labels.quality` from at most `sample` labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y")).where("_id is not null and _y is not null").where(~F.coalesce(held_out(F.col("_id")), F.lit(True)))
    known = known.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))  # at most `sample` ids
    values = F.struct(*[F.col(f"s_{s}") for s in STATISTICS]).alias("v")
    one = with_statistics(rows.select("_id", "text", "_y")).select("_id", "_y", values).groupBy("_id").agg(F.max("_y").alias("_y"), F.min("v").alias("v"))
    got = one.select("_id", "_y", "v.*").toPandas().sort_values("_id")  # at most `sample` rows
    return fit(got[[f"s_{s}" for s in STATISTICS]].to_numpy(np.float64), got["_y"].to_numpy(np.float64))


def scored(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= least)."""
    rows = with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumn("score", model.score())
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= least, 1).otherwise(0).alias("predicted"))


def kept_documents(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The documents with a score of at least `least`, with all their columns."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return with_statistics(packed).where(model.score() >= least).select("row.*")
