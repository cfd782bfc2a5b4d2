"""URL verdicts: rules first, then a tree of path templates learnt from what the rules and labels say.

Per host, paths are generalised from the root down. Segments that look like numbers or long hexadecimal names are
wildcards at once; a node with very many children that are mostly seen once makes its children one wildcard; siblings
with labels are laid out by block rate and neighbours whose rates do not differ statistically merge. A template is
rejected if its block rate reaches a limit. The rate is that of its own labelled urls, smoothed toward the rest of its
host and, through it, toward the mean rate of hosts, in which each host with labels counts once. A template without
labels takes the rate of the nearest branch above it that has some, up to the whole host.

A turn first walks each node down the segments that all its paths share, then parts it by the next one, so there are as
many turns as forks along a path, however deep it is. Labels are the rules' own verdicts on the urls they fit, or a
given table. All steps are DataFrame operations on distinct generalised paths; urls join their template by host and
path, which Spark may split where one is very common.

Defined results: a null url or one without :// has an empty host and path; urls of a host without any labels are
allowed unless a rule fits; rows that repeat are counted and returned each; of several labels of a page the greatest
word counts. Only page_id and url are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curaspark.llm.common import Store

#: Children of a node become one wildcard from so many on, if so many in a hundred of its urls lie in children seen once.
MANY_CHILDREN, SINGLES_PERCENT = 20, 50
#: Siblings are binned by block rate, so a node has at most `BINS` + 1 bins whatever its children; neighbouring bins merge whose
#: siblings, with the labels that each has on average, differ by less than `SAME_Z`.
BINS, SAME_Z = 32, 1.96
PRIOR_WEIGHT, REJECT_RATE = 5.0, 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str]


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: str) -> Column:
    host, slash, path = rule.partition("/")
    return ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(slash + path))


def with_rules(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds `rule` and `ruled` (its verdict): those of the longest rule that fits host and path, else null."""
    rule = ruled = F.lit(None).cast("string")
    for verdict, pattern in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule, ruled = F.when(_fits(pattern), pattern).otherwise(rule), F.when(_fits(pattern), verdict).otherwise(ruled)
    return rows.withColumn("rule", rule).withColumn("ruled", ruled)


def _segments(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, r"(?i)^(?=[a-f]*\d)[0-9a-f]{8,}(?=\.|$)", "{hex}"), r"\d+", "{n}"))


def _rate(prior: float) -> Column:
    """Block rate of a branch with labels; each label of its host (host_labelled, host_blocked) counts once."""
    rest = (F.col("host_blocked") - F.col("blocked") + PRIOR_WEIGHT * prior) / (F.col("host_labelled") - F.col("labelled") + PRIOR_WEIGHT)
    return F.when(F.col("labelled") > 0, (F.col("blocked") + PRIOR_WEIGHT * rest) / (F.col("labelled") + PRIOR_WEIGHT))


def _shared(low: Column, high: Column) -> Column:
    """How many leading segments the least and the greatest of some paths share, and so all of them."""
    parting = F.array_position(F.zip_with(low, high, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(parting == 0, F.size(low)).otherwise(parting - 1).cast("int")


def _walked(active: DataFrame, hosts: DataFrame, prior: float) -> DataFrame:
    """Paths moved down from their nodes by the segments that all paths of the node share."""
    nodes = active.groupBy("host", "template").agg(F.min("rest").alias("low"), F.max("rest").alias("high"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    nodes = nodes.withColumn("shared", _shared(F.col("low"), F.col("high"))).where("shared > 0").join(hosts, "host")
    nodes = nodes.select("host", "template", "shared", F.concat("template", F.lit("/"), F.array_join(F.slice("low", F.lit(1), F.col("shared")), "/")).alias("to"), _rate(prior).alias("rate"))
    rest = F.when(F.col("shared").isNull(), F.col("rest")).otherwise(F.slice("rest", F.col("shared") + 1, F.size("rest")))
    moved = active.join(nodes, ["host", "template"], "left")
    return moved.select("host", "segs", rest.alias("rest"), "n", "labelled", "blocked", F.coalesce("to", "template").alias("template"), F.coalesce("rate", "above").alias("above"))


def _steps(children: DataFrame) -> DataFrame:
    """children (host, template, seg, n, labelled, blocked) with `step`: the segment, a wildcard or the first bin of a merged run."""
    node = ["host", "template"]
    nodes = children.groupBy(*node).agg(F.count("*").alias("kids"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("singles"), F.sum("n").alias("visits"))
    nodes = nodes.select(*node, ((F.col("kids") >= MANY_CHILDREN) & (100 * F.col("singles") >= SINGLES_PERCENT * F.col("visits"))).alias("wild"))
    binned = children.withColumn("bin", F.try_divide(F.col("blocked") * BINS, F.col("labelled")).cast("int"))
    bins = binned.where("bin is not null").groupBy(*node, "bin").agg(F.count("*").alias("kids"), F.avg("labelled").alias("l"), F.avg("blocked").alias("b"))
    order = Window.partitionBy(*node).orderBy("bin")  # at most `BINS` + 1 rows a node
    l0, b0 = F.lag("l").over(order), F.lag("b").over(order)
    # of single siblings: summed bins would part alike siblings once there are many of them
    pooled = (F.col("b") + b0) / (F.col("l") + l0)
    error = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1 / F.col("l") + 1 / l0))
    apart = F.coalesce(F.abs(F.col("b") / F.col("l") - b0 / l0) / error >= SAME_Z, F.lit(True))
    runs = bins.withColumn("run", F.max(F.when(apart, F.col("bin"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("merged", F.sum("kids").over(Window.partitionBy(*node, "run")) > 1).where("merged").select(*node, "bin", "run")
    step = F.when(F.col("wild"), "*").when(F.col("run").isNotNull(), F.format_string("{same %d}", "run")).otherwise(F.col("seg"))
    return binned.join(nodes, node).join(runs, [*node, "bin"], "left").select(*node, "seg", step.alias("step"), "labelled", "blocked")


def _generalised(paths: DataFrame, hosts: DataFrame, prior: float, store: Store) -> DataFrame:
    """paths (host, segs, n, labelled, blocked) with `template`, fork by fork from the root, and `above`.

    above: the rate of the nearest branch with labels that the template lies in or is; null if that is the host.
    """
    now = paths.withColumn("rest", F.col("segs")).withColumn("template", F.lit("")).withColumn("above", F.lit(None).cast("double"))
    turn = 0
    while True:
        ended = store.save(now.where("size(rest) = 0").drop("rest"), f"ended/turn={turn}")
        active = now.where("size(rest) > 0")
        if active.isEmpty():
            return store.spark.read.schema(ended.schema).parquet(f"{store.root}/ended").select(*ended.columns)
        walked = store.save(_walked(active, hosts, prior), f"walked-{turn}")
        here = walked.withColumn("seg", F.get("rest", F.lit(0)))
        children = here.where("seg is not null").groupBy("host", "template", "seg").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "blocked")))
        steps = store.save(_steps(store.save(children, f"children-{turn}")), f"steps-{turn}")
        branches = steps.groupBy("host", "template", "step").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")).join(hosts, "host")
        branches = branches.select("host", "template", "step", _rate(prior).alias("rate"))
        rated = store.save(steps.select("host", "template", "seg", "step").join(branches, ["host", "template", "step"]), f"rated-{turn}")
        new = here.join(rated, ["host", "template", "seg"], "left")
        rest = F.slice("rest", F.lit(2), F.greatest(F.size("rest") - 1, F.lit(0)))
        new = new.select("host", "segs", rest.alias("rest"), "n", "labelled", "blocked", F.when(F.col("step").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "step")).alias("template"), F.coalesce("rate", "above").alias("above"))
        now = store.save(new, f"turn-{turn}")
        store.drop(f"children-{turn}", f"steps-{turn}", f"rated-{turn}", f"walked-{turn}", *([f"turn-{turn - 1}"] if turn else []))
        turn += 1


def judged(pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and template. `labels`, if given, has page_id and label (allow or block)."""
    store = Store(pages.sparkSession, "urlfilter")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = with_rules(rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules).withColumn("label", F.col("ruled"))
    if labels is not None:
        own = labels.groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.max("label").alias("given"))
        rows = rows.join(own, "page_id", "left").withColumn("label", F.coalesce("given", "label")).drop("given")
    rows = store.save(rows.withColumn("segs", _segments(F.col("path"))), "rows")
    sums = (F.count("*").alias("n"), F.count("label").alias("labelled"), F.count_if(F.col("label") == "block").alias("blocked"))
    paths = store.save(rows.groupBy("host", "segs").agg(*sums), "paths")
    hosts = store.save(paths.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("blocked").alias("host_blocked")), "hosts")
    prior = hosts.where("host_labelled > 0").agg(F.avg(F.col("host_blocked") / F.col("host_labelled")).alias("p")).first()["p"] or 0.0
    known = _generalised(paths, hosts, prior, store)
    templates = known.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"), F.max("above").alias("above")).join(hosts, "host")
    whole = (F.col("host_blocked") + PRIOR_WEIGHT * prior) / (F.col("host_labelled") + PRIOR_WEIGHT)
    block = (F.col("host_labelled") > 0) & (F.coalesce(_rate(prior), "above", whole) >= REJECT_RATE)
    templates = templates.select("host", "template", F.when(block, "block").otherwise("allow").alias("found"))
    found = store.save(known.select("host", "segs", "template").join(templates, ["host", "template"]), "found")
    ruled = rows.where("ruled is not null").select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict"), F.lit(None).cast("string").alias("template"))
    free = rows.where("ruled is null").join(found, ["host", "segs"]).select("page_id", "host", "path", "rule", F.col("found").alias("verdict"), "template")
    return ruled.unionAll(free)
