"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.llm.common import Store


def _star(edges: DataFrame, centre: str, other: str) -> DataFrame:
    """Each `other` of a centre now points at the least vertex around that centre."""
    least = edges.groupBy(centre).agg(F.least(F.min(other), F.first(centre)).alias("m"))
    return edges.join(least, centre).select(F.col(other).alias("v"), "m", F.col(centre).alias("c"))


def _unsettled(edges: DataFrame) -> bool:
    """Whether some vertex points at two others, or is pointed at and points."""
    ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    return bool(ends.groupBy("u").agg(F.sum("out").alias("o"), F.max("into").alias("i")).where("o > 1 or (o = 1 and i = 1)").limit(1).count())


def components(edges: DataFrame, store: Store, name: str) -> DataFrame:
    """(v, comp) for every vertex v that is not its component's least vertex; comp is that least vertex.

    `edges` has two columns a and b of integers; self-loops and repeats are allowed. Vertices are never collected:
    each step is an aggregation and a join on a vertex, and a step's edges are written before the next step.
    An empty table gives an empty table.
    """
    now = store.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    step = 0
    while _unsettled(now):
        step += 1
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "u", "v").where("v > c").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = store.save(large, f"{name}-{step}-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        small = store.save(small, f"{name}-{step}")
        store.drop(f"{name}-{step}-large", f"{name}-{step - 1}")
        now = small
    return now.select(F.col("u").alias("v"), F.col("v").alias("comp"))
