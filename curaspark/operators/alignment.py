"""Agreement of decisions with truth: confusion, accuracy, sequence distance and learning curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One character per action; anything else becomes '?', which no true action uses.
ACTION_CODES = {"SPLIT": "S", "MERGE": "M", "DISCARD": "D", "KEEP": "K", "NOT_MERGE": "N"}


def _upper(c: str) -> Column:
    return F.upper(F.coalesce(F.col(c), F.lit("")))


def confusion(predictions: DataFrame, by: list[str]) -> DataFrame:
    return predictions.groupBy(*by, _upper("gt_action").alias("gt_action"), _upper("student_action").alias("student_action")).agg(F.count("*").alias("n"))


def confusion_table(predictions: DataFrame, labels: list[str]) -> DataFrame:
    """The square table of counts with zeros, labels in order; labels are a short list of actions."""
    wide = confusion(predictions, []).groupBy("gt_action").pivot("student_action", labels).sum("n")
    rows = predictions.sparkSession.createDataFrame([(x,) for x in labels], "gt_action string")
    return rows.join(wide, "gt_action", "left").na.fill(0)


def accuracy(predictions: DataFrame, group: str) -> DataFrame:
    """n, correct and accuracy per group and true action, and per group for ALL, rounded to 4 places."""
    rows = predictions.select(group, _upper("gt_action").alias("gt_action"), (_upper("gt_action") == _upper("student_action")).cast("bigint").alias("ok"))
    got = rows.groupingSets([[group, "gt_action"], [group]], group, "gt_action").agg(F.count("*").alias("n"), F.sum("ok").alias("correct"), F.grouping("gt_action").alias("all"))
    return got.select(group, F.when(F.col("all") == 1, "ALL").otherwise(F.col("gt_action")).alias("gt_action"), "n", "correct", F.round(F.col("correct") / F.col("n"), 4).alias("accuracy"))


def overall_accuracy(table: DataFrame) -> DataFrame:
    """Accuracy over groups weighted by n, from the ALL rows of `accuracy`; their mean if n is nowhere known."""
    rows = table.where("gt_action = 'ALL'")
    weighted = F.sum("correct") / F.when(F.sum("n") > 0, F.sum("n"))
    return rows.agg(F.coalesce(weighted, F.avg("accuracy"), F.lit(0.0)).alias("accuracy"))


def edit_distance(predictions: DataFrame, session: str, order: str) -> DataFrame:
    """Levenshtein distance of the action sequences of each session: each action is a character."""

    def code(c: str) -> Column:
        out = F.lit("?")
        for name, letter in ACTION_CODES.items():
            out = F.when(_upper(c) == name, letter).otherwise(out)
        return out

    def text(field: str) -> Column:
        return F.array_join(F.transform("s", lambda x: x[field]), "")

    # a session's sequence is as long as its steps
    got = predictions.groupBy(session).agg(F.sort_array(F.collect_list(F.struct(order, code("gt_action").alias("g"), code("student_action").alias("p")))).alias("s"))
    return got.select(session, F.size("s").cast("bigint").alias("n_steps"), F.levenshtein(text("g"), text("p")).cast("bigint").alias("edit_distance"))


def rolling_accuracy(rows: DataFrame, group: str, order: str, value: str, before: int = 5, after: int = 4) -> DataFrame:
    """Centred rolling mean per group over `before` rows back to `after` rows ahead, shorter at the ends."""
    frame = Window.partitionBy(group).orderBy(order).rowsBetween(-before, after)
    return rows.withColumn("rolling", F.avg(value).over(frame))


def global_steps(rows: DataFrame, session: str, rank: str, step: str) -> DataFrame:
    """Numbers steps of a session through its groups in order of (rank, step), from 1."""
    return rows.withColumn("global_step", F.row_number().over(Window.partitionBy(session).orderBy(rank, step)))


def boundaries(rows: DataFrame, by: list[str]) -> DataFrame:
    got = rows.groupBy(*by).agg(F.min("global_step").alias("first"), F.max("global_step").alias("last"))
    return got.withColumn("midpoint", (F.col("first") + F.col("last")) / 2)


def recall_by_action(predictions: DataFrame, actions: list[str]) -> DataFrame:
    """Overall accuracy and recall of each action as columns; 0 where there is none."""
    hit = (_upper("gt_action") == _upper("student_action")).cast("double")
    recalls = [F.coalesce(F.avg(F.when(_upper("gt_action") == a, hit)), F.lit(0.0)).alias(f"recall_{a.lower()}") for a in actions]
    return predictions.agg(F.count("*").alias("n"), F.coalesce(F.avg(hit), F.lit(0.0)).alias("accuracy"), *recalls)


def action_counts(steps: DataFrame, by: list[str]) -> DataFrame:
    return steps.groupBy(*by, _upper("gt_action").alias("gt_action")).agg(F.count("*").alias("n"))
