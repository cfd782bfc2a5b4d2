"""Registered queries on sessions: trees, retrieval, agreement, summaries, text and datasets, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curaspark.functions import arrays, text
from curaspark.operators import alignment, curation, datasets, matching, pipelines, retrieval, state, summaries, units
from curaspark.plans.unit_queries import SPIKES, TREF, correlated, expert_pairs, rounded
from curaspark.sources.tables import merge_tree, spikes, table, waves

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

ACTIONS = ["SPLIT", "MERGE", "DISCARD", "KEEP", "NOT_MERGE"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _choice(n: Column, names: list[str]) -> Column:
    out = F.lit(names[-1])
    for i, name in enumerate(names[:-1]):
        out = F.when(n == i, name).otherwise(out)
    return out


def _choice_sql(n: str, names: list[str]) -> str:
    return f"CASE {n} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(names[:-1])) + f" ELSE '{names[-1]}' END"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as decision steps: a true and a chosen action a turn, by ids and by the length of the text."""
    size = F.length(F.coalesce("text", F.lit("")))
    gt = _choice((F.col("conv_id") + F.col("turn")) % 5, ACTIONS)
    chosen = F.when(size % 11 == 0, F.lit("")).otherwise(_choice(F.when(size % 3 == 0, size % 5).otherwise((F.col("conv_id") + F.col("turn")) % 5), ACTIONS))
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") % 7).cast("bigint").alias("channel"), F.col("conv_id").alias("session"), F.col("turn").alias("step"), gt.alias("gt_action"), chosen.alias("student_action"), size.cast("bigint").alias("n_spikes"), F.col("role"), F.col("text"))


STEPS = f"""steps AS (SELECT CAST(conv_id % 7 AS BIGINT) AS channel, conv_id AS session, turn AS step, {_choice_sql('((conv_id + turn) % 5)', ACTIONS)} AS gt_action,
  CASE WHEN length(coalesce(text, '')) % 11 = 0 THEN '' ELSE {_choice_sql("(CASE WHEN length(coalesce(text, '')) % 3 = 0 THEN length(coalesce(text, '')) % 5 ELSE (conv_id + turn) % 5 END)", ACTIONS)} END AS student_action,
  CAST(length(coalesce(text, '')) AS BIGINT) AS n_spikes, role, text FROM conversations)"""

OCMAP = SPIKES + ", own AS (SELECT channel_id, cl, min(oc) AS top FROM spikes GROUP BY ALL)"


@query(f"WITH {OCMAP} SELECT s.channel_id, s.spike_id, o.top AS cl FROM spikes s JOIN own o ON s.channel_id = o.channel_id AND s.cl = o.cl")
def tree_replay(spark, sf_dir):
    s = spikes(spark, sf_dir)
    return state.replayed(s, merge_tree(s)).select("channel_id", "spike_id", "cl")


@query(f"""WITH {OCMAP}, m AS (SELECT s.channel_id, o.top AS cl, max(s.oc) FILTER (s.oc <> o.top) AS breakaway FROM spikes s JOIN own o ON s.channel_id = o.channel_id AND s.cl = o.cl GROUP BY ALL)
SELECT channel_id, cl, breakaway, CASE WHEN breakaway IS NULL THEN '' ELSE CAST(breakaway AS VARCHAR) END AS labels FROM m""")
def split_last_merge(spark, sf_dir):
    s = spikes(spark, sf_dir)
    tree = merge_tree(s)
    tops = s.groupBy("channel_id", "cl").agg(F.min("oc").alias("top")).select("channel_id", F.col("top").alias("cl"))
    got = state.last_merge_split(tree, tops)
    return got.withColumn("labels", F.array_join(F.transform("labels", lambda x: x.cast("string")), ","))


@query()
def hierarchy_agglomerate(spark, sf_dir):
    return state.agglomerated(units.templates(waves(spark, sf_dir), "mean"), least=0.05)


@query()
def gt_trajectory(spark, sf_dir):
    s = spikes(spark, sf_dir)
    tree = merge_tree(s)
    return state.trajectories(state.replayed(s, tree), tree, threshold=0.22)


@query(f"""WITH {SPIKES}, n AS (SELECT channel_id, cl, count(DISTINCT oc) AS k FROM spikes GROUP BY ALL)
SELECT channel_id, cl, k AS n_leaves, k - 1 AS n_merges, CAST(1 AS BIGINT) AS n_roots, round(CAST(0.5 AS DOUBLE) * (k - 1), 6) AS height, CASE WHEN k > 1 THEN 'complete' ELSE 'flat' END AS kind FROM n""")
def aggregation_forest(spark, sf_dir):
    s = spikes(spark, sf_dir)
    return state.forest(merge_tree(s).withColumn("similarity", F.lit(0.5)), s)


MEMORY = """mem AS (SELECT CAST(vec_id % 4 AS BIGINT) AS session, CAST(vec_id AS BIGINT) AS seq, CASE WHEN label % 2 = 0 THEN 'phase1' ELSE 'phase2' END AS phase, CAST(embedding AS DOUBLE[]) AS template,
  [CAST(label AS DOUBLE), CAST(vec_id % 10 + 1 AS DOUBLE)] AS features, CASE WHEN vec_id % 6 = 0 THEN '' ELSE 'KEEP' END AS gt_action, CASE WHEN vec_id % 5 = 0 THEN '  ' ELSE 'r' END AS gt_reasoning FROM embeddings)"""


@query(f"""WITH {MEMORY}, sc AS (SELECT q.session, q.seq, m.seq AS entry_seq, 0.7 * list_cosine_similarity(q.template, m.template) + 0.3 * list_cosine_similarity(q.features, m.features) AS score
  FROM mem q JOIN mem m ON q.session = m.session AND q.phase = m.phase AND m.seq < q.seq WHERE length(m.gt_action) > 0 AND length(trim(m.gt_reasoning)) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY session, seq ORDER BY score DESC, entry_seq) AS rank FROM sc) SELECT session, seq, CAST(rank AS INTEGER) AS rank, entry_seq, round(score, 6) AS score FROM r WHERE rank <= 3""")
def retrieval_topk(spark, sf_dir):
    v, label = F.col("vec_id"), F.col("label")
    memory = table(spark, sf_dir, "embeddings").select(
        (v % 4).cast("bigint").alias("session"),
        v.cast("bigint").alias("seq"),
        F.when(label % 2 == 0, "phase1").otherwise("phase2").alias("phase"),
        F.col("embedding").cast("array<double>").alias("template"),
        F.array(label.cast("double"), (v % 10 + 1).cast("double")).alias("features"),
        F.when(v % 6 == 0, "").otherwise("KEEP").alias("gt_action"),
        F.when(v % 5 == 0, "  ").otherwise("r").alias("gt_reasoning"),
    )
    return retrieval.retrieved(memory, memory, 3)


@query("""WITH p AS (SELECT a.label, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT CAST(label AS BIGINT) AS label, round(avg(c), 6) AS alignment, count(*) AS n FROM p GROUP BY ALL""")
def rationale_alignment(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    a = e.select(F.col("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").cast("array<double>").alias("y"))
    return retrieval.rationale_alignment(a.join(b, "vec_id"), "x", "y", ["label"])


FEATURES = f"""{SPIKES}, i AS (SELECT *, t - lag(t) OVER (PARTITION BY channel_id, cl ORDER BY t) AS isi FROM spikes),
f AS (SELECT channel_id, cl, count(*) AS n, CASE WHEN count(*) > 1 THEN count(*) FILTER (isi < {TREF}) / (count(*) - 1) ELSE 0 END AS r, avg(amp) AS m, coalesce(stddev_samp(amp), 0) AS s FROM i GROUP BY ALL)"""


@query(f"WITH {FEATURES} SELECT channel_id, cl, round(ln(1 + n) / 10, 6) AS f1, round(r, 6) AS f2, round(ln(1 + greatest(0, m)), 6) AS f3, round(ln(1 + greatest(0, s)), 6) AS f4, round(CASE WHEN m > 0 THEN s / m ELSE 0 END, 6) AS f5 FROM f")
def phase1_features(spark, sf_dir):
    s = spikes(spark, sf_dir)
    f = units.unit_features(s, TREF, 86400.0).join(units.interval_violations(s, TREF).select("channel_id", "cl", "rate"), ["channel_id", "cl"])
    v = retrieval.phase1_features(F.col("n_spikes"), F.col("rate"), F.col("amplitude_mean"), F.col("amplitude_std"), F.col("amplitude_cv"), F.lit(0.0))
    return f.select("channel_id", "cl", *(F.get(v, F.lit(i)).alias(f"f{i + 1}") for i in range(5)))


@query(f"WITH {STEPS} SELECT gt_action, student_action, count(*) AS n FROM steps GROUP BY ALL")
def action_confusion(spark, sf_dir):
    return alignment.confusion(predictions(spark, sf_dir), [])


@query(f"WITH {STEPS} SELECT gt_action, " + ", ".join(f"count(*) FILTER (student_action = '{a}') AS \"{a}\"" for a in ACTIONS) + " FROM steps GROUP BY gt_action")
def confusion_square(spark, sf_dir):
    return alignment.confusion_table(predictions(spark, sf_dir), ACTIONS)


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def label_confusion(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query(f"""WITH {STEPS} SELECT channel, CASE WHEN grouping(gt_action) = 1 THEN 'ALL' ELSE gt_action END AS gt_action, count(*) AS n, CAST(sum(CASE WHEN gt_action = student_action THEN 1 ELSE 0 END) AS BIGINT) AS correct,
  round(sum(CASE WHEN gt_action = student_action THEN 1 ELSE 0 END) / count(*), 4) AS accuracy FROM steps GROUP BY GROUPING SETS ((channel, gt_action), (channel))""")
def action_accuracy_all(spark, sf_dir):
    return alignment.accuracy(predictions(spark, sf_dir), "channel")


@query(f"WITH {STEPS} SELECT round(sum(CASE WHEN gt_action = student_action THEN 1 ELSE 0 END) / count(*), 6) AS accuracy FROM steps")
def overall_accuracy(spark, sf_dir):
    return alignment.overall_accuracy(alignment.accuracy(predictions(spark, sf_dir), "channel"))


CODES = "CASE {0} WHEN 'SPLIT' THEN 'S' WHEN 'MERGE' THEN 'M' WHEN 'DISCARD' THEN 'D' WHEN 'KEEP' THEN 'K' WHEN 'NOT_MERGE' THEN 'N' ELSE '?' END"


@query(f"WITH {STEPS} SELECT session, count(*) AS n_steps, CAST(levenshtein(string_agg({CODES.format('gt_action')}, '' ORDER BY step), string_agg({CODES.format('student_action')}, '' ORDER BY step)) AS BIGINT) AS edit_distance FROM steps GROUP BY session")
def action_edit_distance(spark, sf_dir):
    return alignment.edit_distance(predictions(spark, sf_dir), "session", "step")


@query(f"WITH {STEPS} SELECT count(*) AS n, round(avg(CASE WHEN gt_action = student_action THEN 1.0 ELSE 0.0 END), 6) AS accuracy, " + ", ".join(f"round(coalesce(avg(CASE WHEN gt_action = student_action THEN 1.0 ELSE 0.0 END) FILTER (gt_action = '{a}'), 0), 6) AS recall_{a.lower()}" for a in ACTIONS[:3]) + " FROM steps")
def recall_by_action(spark, sf_dir):
    return alignment.recall_by_action(predictions(spark, sf_dir), ACTIONS[:3])


@query(f"WITH {STEPS} SELECT channel, gt_action, count(*) AS n FROM steps GROUP BY ALL")
def trajectory_summary(spark, sf_dir):
    return alignment.action_counts(predictions(spark, sf_dir), ["channel"])


LEARNING = STEPS + ", g AS (SELECT channel, session, step, CASE WHEN gt_action = student_action THEN 1.0 ELSE 0.0 END AS hit, row_number() OVER (PARTITION BY channel ORDER BY session, step) AS global_step FROM steps)"


@query(f"WITH {LEARNING} SELECT channel, CAST(global_step AS INTEGER) AS global_step, round(avg(hit) OVER (PARTITION BY channel ORDER BY global_step ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), 6) AS rolling FROM g")
def rolling_learning_curve(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("hit", (F.col("gt_action") == F.col("student_action")).cast("double"))
    return alignment.rolling_accuracy(alignment.global_steps(p, "channel", "session", "step"), "channel", "global_step", "hit").select("channel", "global_step", "rolling")


@query(f"WITH {LEARNING} SELECT channel, session, CAST(min(global_step) AS INTEGER) AS first, CAST(max(global_step) AS INTEGER) AS last, (min(global_step) + max(global_step)) / 2 AS midpoint FROM g GROUP BY ALL")
def session_boundaries(spark, sf_dir):
    return alignment.boundaries(alignment.global_steps(predictions(spark, sf_dir), "channel", "session", "step"), ["channel", "session"])


@query(f"""WITH {STEPS}, a AS (SELECT session, CAST(step AS BIGINT) AS step, gt_action AS action_type, n_spikes % 4 AS cluster_id, CASE WHEN gt_action = 'MERGE' AND n_spikes % 3 > 0 THEN n_spikes % 5 END AS target_id FROM steps),
b AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY step) - 1 AS pos, count(*) OVER (PARTITION BY session) - 1 AS lst FROM a), d AS (SELECT session, cluster_id AS gone, min(pos) AS gone_at FROM b WHERE action_type = 'DISCARD' GROUP BY ALL)
SELECT b.session, b.step, action_type, b.step <> pos AS bad_step, action_type NOT IN ('SPLIT', 'MERGE', 'DISCARD', 'KEEP') AS unknown_action, cluster_id IS NULL AS no_cluster, coalesce(o.gone_at < pos, false) AS discarded_cluster,
  action_type = 'MERGE' AND target_id IS NULL AS no_target, coalesce(action_type = 'MERGE' AND t.gone_at < pos, false) AS discarded_target, action_type = 'KEEP' AND pos < lst AS early_keep
FROM b LEFT JOIN d o ON o.session = b.session AND o.gone = b.cluster_id LEFT JOIN d t ON t.session = b.session AND t.gone = b.target_id""")
def discard_reuse_check(spark, sf_dir):
    p = predictions(spark, sf_dir)
    n = F.col("n_spikes")
    actions = p.select("session", F.col("step").cast("bigint").alias("step"), F.col("gt_action").alias("action_type"), (n % 4).alias("cluster_id"), F.when((F.col("gt_action") == "MERGE") & (n % 3 > 0), n % 5).alias("target_id"))
    return curation.checked_actions(actions)


@query("""WITH o AS (SELECT n_regionkey AS region, c_nationkey AS nation, avg(o_totalprice / 1000) AS p, count(*) / 100.0 AS k FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT region, round(avg(p), 6) AS p_mean, round(stddev_samp(p), 6) AS p_std, round(avg(k), 6) AS k_mean, round(stddev_samp(k), 6) AS k_std FROM o GROUP BY region""")
def channel_mean_std(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("n_regionkey").alias("region"), "c_nationkey").agg(F.avg(F.col("o_totalprice") / 1000).alias("p"), (F.count("*") / 100.0).alias("k"))
    return summaries.mean_std(rows, ["p", "k"], ["region"])


@query("""WITH r AS (SELECT o_orderpriority AS method, count(*) FILTER (o_orderstatus = 'F') AS tp, count(*) FILTER (o_orderstatus = 'O') AS fp, count(*) FILTER (o_orderstatus = 'P') AS fn FROM orders GROUP BY ALL)
SELECT method, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM r""")
def micro_from_totals(spark, sf_dir):
    s = F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("method"), (F.col("o_custkey") % 4).alias("channel")).agg(F.count_if(s == "F").alias("tp"), F.count_if(s == "O").alias("fp"), F.count_if(s == "P").alias("fn"))
    return summaries.micro(rows, ["method"])


@query("SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'Total' ELSE o_orderpriority END AS o_orderpriority, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders GROUP BY ROLLUP (o_orderpriority)")
def grand_total(spark, sf_dir):
    return summaries.grand_total(table(spark, sf_dir, "orders"), "o_orderpriority", [F.count("*").alias("n"), F.sum("o_custkey").alias("keys")])


@query("""WITH a AS (SELECT c_nationkey AS k, CAST(count(*) AS DOUBLE) AS v FROM customer WHERE c_acctbal > 9500 GROUP BY 1), b AS (SELECT s_nationkey AS k, CAST(count(*) AS DOUBLE) AS v FROM supplier GROUP BY 1)
SELECT k, coalesce(a.v, 0) AS left_value, coalesce(b.v, 0) AS right_value, coalesce(b.v, 0) - coalesce(a.v, 0) AS delta FROM a FULL OUTER JOIN b USING (k)""")
def mode_delta(spark, sf_dir):
    a = table(spark, sf_dir, "customer").where("c_acctbal > 9500").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").cast("double").alias("v"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").cast("double").alias("v"))
    return matching.mode_delta(a, b, "k", "v")


CALLS = """calls AS (SELECT o_orderpriority AS role, o_custkey % 900 AS input_tokens, o_custkey % 100 AS cached_input_tokens, o_custkey % 900 AS uncached_input_tokens, CASE WHEN o_custkey % 900 = 0 THEN 0 ELSE o_orderkey % 300 END AS output_tokens, 0 AS reasoning_output_tokens, o_custkey % 900 + o_orderkey % 300 AS total_tokens, o_totalprice AS cost_usd FROM orders)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as model calls of five roles."""
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("role"), (c % 900).alias("input_tokens"), (c % 100).alias("cached_input_tokens"), (c % 900).alias("uncached_input_tokens"), F.when(c % 900 == 0, 0).otherwise(o % 300).alias("output_tokens"), F.lit(0).alias("reasoning_output_tokens"), (c % 900 + o % 300).alias("total_tokens"), F.col("o_totalprice").alias("cost_usd"))


@query(f"""WITH {CALLS}, r AS (SELECT role, cost_usd, row_number() OVER (PARTITION BY role ORDER BY cost_usd) - 1 AS i, count(*) OVER (PARTITION BY role) AS n FROM calls)
SELECT role, round(max(cost_usd) FILTER (i = floor(0.5 * (n - 1))), 6) AS p50, round(max(cost_usd) FILTER (i = floor(0.95 * (n - 1))), 6) AS p95 FROM r GROUP BY role""")
def budget_percentiles(spark, sf_dir):
    return summaries.lower_percentiles(calls(spark, sf_dir), ["role"], "cost_usd", [("p50", 0.5), ("p95", 0.95)])


@query(f"""WITH {CALLS} SELECT role, count(*) AS calls, count(*) FILTER (input_tokens = 0 AND output_tokens = 0) AS missing_usage_calls, CAST(sum(input_tokens) AS DOUBLE) AS input_tokens, round(avg(output_tokens), 6) AS avg_output_tokens, round(max(cost_usd), 6) AS max_call_cost_usd FROM calls GROUP BY role""")
def role_usage(spark, sf_dir):
    return summaries.role_usage(calls(spark, sf_dir), ["role"]).select("role", "calls", "missing_usage_calls", "input_tokens", "avg_output_tokens", "max_call_cost_usd")


PRICES = [("economy", 2.0, 0.5, 8.0), ("small", 1.0, 0.25, 4.0), ("small-mini", 0.25, 0.05, 1.0), ("standard", 3.0, 1.0, 12.0)]
PRICE_SQL = "prices(key, input, cached, output) AS (VALUES " + ", ".join(f"('{k}', {a}, {b}, {c})" for k, a, b, c in PRICES) + ")"
MODELS = "models AS (SELECT p_partkey, lower(p_type) || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '-mini' WHEN 2 THEN '-mini-x' ELSE 'er' END AS model FROM part)"


@query(f"""WITH {PRICE_SQL}, {MODELS}, h AS (SELECT m.p_partkey, m.model, p.*, row_number() OVER (PARTITION BY p_partkey ORDER BY length(key) DESC) AS k FROM models m LEFT JOIN prices p ON m.model = p.key OR starts_with(m.model, p.key || '-'))
SELECT p_partkey, model, key AS pricing_key, round((1000 * CAST(input AS DOUBLE) + 200 * CAST(cached AS DOUBLE) + 50 * CAST(output AS DOUBLE)) / 1e6, 9) AS cost FROM h WHERE k = 1""")
def prefix_pricing(spark, sf_dir):
    prices = spark.createDataFrame(PRICES, "key string, input double, cached double, output double")
    suffix = _choice(F.col("p_partkey") % 4, ["", "-mini", "-mini-x", "er"])
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lower("p_type"), suffix).alias("model"))
    priced = matching.prefix_priced(rows, prices)
    cost = text.cost(F.lit(1000), F.lit(200), F.lit(50), F.col("input"), F.col("cached"), F.col("output"))
    return priced.select("p_partkey", "model", "pricing_key", F.round(cost, 9).alias("cost"))


@query("""WITH b AS (SELECT s_nationkey AS nation, avg(s_acctbal) AS bal, CAST(count(*) AS DOUBLE) AS n FROM supplier GROUP BY ALL), e AS (SELECT min(bal) AS lb, max(bal) AS hb, min(n) AS ln, max(n) AS hn FROM b)
SELECT nation, round(CASE WHEN hb > lb THEN (bal - lb) / (hb - lb) ELSE 0.5 END, 6) AS bal, round(CASE WHEN hn > ln THEN 1 - (n - ln) / (hn - ln) ELSE 0.5 END, 6) AS n FROM b, e""")
def radar_normalise(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.avg("s_acctbal").alias("bal"), F.count("*").cast("double").alias("n"))
    return summaries.normalised(rows, ["bal", "n"], ["n"])


@query("""WITH b AS (SELECT o_orderpriority AS method, avg(o_totalprice) AS p, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY ALL), z AS (SELECT p AS zp, n AS zn FROM b WHERE method = '5-LOW') SELECT method, round(p / zp, 6) AS p, round(n / zn, 6) AS n FROM b, z""")
def baseline_ratio(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("method")).agg(F.avg("o_totalprice").alias("p"), F.count("*").cast("double").alias("n"))
    return summaries.against_baseline(rows, "method", "5-LOW", ["p", "n"])


@query("""WITH m AS (SELECT c_mktsegment AS segment, c_nationkey AS nation, avg(c_acctbal) AS m FROM customer GROUP BY ALL) SELECT segment, round(avg(m), 6) AS mean_of_means, count(*) AS groups FROM m GROUP BY segment""")
def mean_of_means(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), "c_acctbal")
    return summaries.mean_of_means(rows, ["nation"], ["segment"], "c_acctbal")


SHEET = """sheet AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 's ' || user_id WHEN 1 THEN 'm ' || (user_id + 1) || ' ' || (event_id % 50) WHEN 2 THEN 'm 0 ' || user_id WHEN 3 THEN 'm 0 ' || user_id || '.0' WHEN 4 THEN 's x' ELSE 's ' || user_id || ' ;' END AS line FROM events)"""


@query(f"""WITH {SHEET}, e AS (SELECT event_id, line, regexp_extract(line, '^s\\s+(\\d+)(?:\\.0+)?\\s*$', 1) AS one, regexp_extract(line, '^m\\s+(\\d+)(?:\\.0+)?\\s+(\\d+)(?:\\.0+)?\\s*$', 1) AS fst, regexp_extract(line, '^m\\s+(\\d+)(?:\\.0+)?\\s+(\\d+)(?:\\.0+)?\\s*$', 2) AS snd FROM sheet)
SELECT event_id, CASE WHEN one <> '' THEN 'split' WHEN fst = '0' THEN 'discard' WHEN fst <> '' THEN 'merge' END AS action, CASE WHEN one <> '' THEN CAST(one AS BIGINT) WHEN fst <> '' THEN CAST(snd AS BIGINT) END AS cluster_id, CASE WHEN one = '' AND fst <> '' AND fst <> '0' THEN CAST(fst AS BIGINT) END AS target_id FROM e""")
def parse_action_sheet(spark, sf_dir):
    u, e = F.col("user_id").cast("string"), F.col("event_id")
    forms = [F.concat(F.lit("s "), u), F.concat(F.lit("m "), (F.col("user_id") + 1).cast("string"), F.lit(" "), (e % 50).cast("string")), F.concat(F.lit("m 0 "), u), F.concat(F.lit("m 0 "), u, F.lit(".0")), F.lit("s x"), F.concat(F.lit("s "), u, F.lit(" ;"))]
    line = F.get(F.array(*forms), (e % 6).cast("int"))
    got = text.parsed_action(line)
    return table(spark, sf_dir, "events").select("event_id", got.getField("action").alias("action"), got.getField("cluster_id").alias("cluster_id"), got.getField("target_id").alias("target_id"))


@query("""WITH s AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents) SELECT doc_id, CASE WHEN length(s) <= 220 THEN s ELSE substr(s, 1, 217) || '...' END AS compact FROM s""")
def compact_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.compact(F.col("text")).alias("compact"))


RESPONSES = """SELECT event_id, CASE event_id % 8 WHEN 0 THEN ' keep ' WHEN 1 THEN 'Thought. {"action": "SPLIT", "n": [1, 2,],} end' WHEN 2 THEN 'Reason: fine.' || chr(10) || 'Action: DISCARD' WHEN 3 THEN '<action> merge </action>' WHEN 4 THEN 'a' || chr(10) || 'FINAL ANSWER: KEEP' WHEN 5 THEN 'perhaps SPLIT or KEEP?' WHEN 6 THEN '```json' || chr(10) || '{"action": "DISCARD" // sure' || chr(10) || '}```' ELSE 'no idea' END AS response FROM events"""


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'KEEP' WHEN 1 THEN 'SPLIT' WHEN 2 THEN 'DISCARD' WHEN 3 THEN 'INVALID_ACTION' WHEN 4 THEN 'KEEP' WHEN 5 THEN 'INVALID_ACTION' WHEN 6 THEN 'DISCARD' ELSE 'PARSE_ERROR' END AS action,
  CASE event_id % 8 WHEN 0 THEN 'KEEP' WHEN 1 THEN 'SPLIT' WHEN 2 THEN 'DISCARD' WHEN 3 THEN 'DISCARD' WHEN 4 THEN 'KEEP' WHEN 5 THEN 'DISCARD' WHEN 6 THEN 'DISCARD' ELSE 'DISCARD' END AS decision FROM events""")
def extract_action(spark, sf_dir):
    e = F.col("event_id")
    forms = [" keep ", 'Thought. {"action": "SPLIT", "n": [1, 2,],} end', "Reason: fine.\nAction: DISCARD", "<action> merge </action>", "a\nFINAL ANSWER: KEEP", "perhaps SPLIT or KEEP?", '```json\n{"action": "DISCARD" // sure\n}```', "no idea"]
    rows = table(spark, sf_dir, "events").select("event_id", _choice(e % 8, forms).alias("response"))
    action = text.extracted_action(F.col("response"), ["KEEP", "DISCARD", "SPLIT"])
    return rows.select("event_id", action.alias("action")).withColumn("decision", text.decided(F.col("action"), 1))


@query("""WITH u AS (SELECT event_id, event_id % 1000 AS i, event_id % 1500 AS c, event_id % 70 AS o FROM events) SELECT event_id, i AS input_tokens, c AS cached_input_tokens, greatest(i - c, 0) AS uncached_input_tokens, o AS output_tokens, i + o AS total_tokens FROM u""")
def usage_normalise(spark, sf_dir):
    e = F.col("event_id")
    one = F.format_string('{"input_tokens": %d, "input_tokens_details": {"cached_tokens": %d}, "output_tokens": %d}', e % 1000, e % 1500, e % 70)
    two = F.format_string('{"prompt_tokens": %d, "prompt_tokens_details": {"cached_tokens": %d}, "completion_tokens": %d}', e % 1000, e % 1500, e % 70)
    rows = table(spark, sf_dir, "events").select("event_id", text.usage(F.when(e % 2 == 0, one).otherwise(two)).alias("u"))
    return rows.select("event_id", *(f"u.{c}" for c in ("input_tokens", "cached_input_tokens", "uncached_input_tokens", "output_tokens", "total_tokens")))


@query("""SELECT event_id, CAST(greatest(0, least(1, value / 100 - 0.2)) AS DOUBLE) AS score, CASE WHEN event_id % 3 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(greatest(0, least(1, event_id % 5 - 1.0)) AS DOUBLE) END AS parsed FROM events""")
def unit_scores(spark, sf_dir):
    e = F.col("event_id")
    raw = F.when(e % 3 == 0, "none").otherwise((e % 5 - 1).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 100 - 0.2)).alias("score"), text.unit_score(raw).alias("parsed"))


@query(f"""WITH {STEPS} SELECT session, step, 'Choose the curation action for cluster ' || session || '.' AS instruction, 'Cluster ' || session || ' has ' || n_spikes || ' events' || CASE WHEN gt_action = 'MERGE' THEN ' with cluster ' || step ELSE '' END || '.' AS input, 'Action: ' || gt_action || chr(10) || 'Reason: ' || role AS output FROM steps WHERE gt_action <> 'KEEP'""")
def sft_examples(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return text.examples(p.select("session", "step", F.col("session").alias("cluster_id"), "n_spikes", F.when(F.col("gt_action") == "MERGE", F.col("step")).alias("target_id"), "gt_action", F.col("role").alias("gt_reasoning")))


@query(f"""WITH {STEPS}, s AS (SELECT *, max(CASE WHEN gt_action = 'KEEP' THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY step) AS seen FROM steps) SELECT session, count(*) AS n FROM s WHERE seen = 1 GROUP BY session""")
def rows_after_prefix(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return datasets.after_prefix(p, ["session"], "step", F.col("gt_action") == "KEEP").groupBy("session").agg(F.count("*").alias("n"))


@query(f"""WITH {SPIKES}, r AS (SELECT channel_id, cl, spike_id, row_number() OVER (PARTITION BY channel_id, cl ORDER BY t, spike_id) - 1 AS i, count(*) OVER (PARTITION BY channel_id, cl) AS n FROM spikes)
SELECT channel_id, cl, spike_id FROM r WHERE n <= 10 OR i IN (SELECT CAST(floor(g * (n - 1) / 9) AS BIGINT) FROM range(0, 10) x(g))""")
def systematic_sample(spark, sf_dir):
    s = spikes(spark, sf_dir).withColumn("o", F.struct("t", "spike_id"))
    return datasets.systematic_sample(s, ["channel_id", "cl"], "o", 10).select("channel_id", "cl", "spike_id")


@query(f"""WITH {STEPS} SELECT channel, session, step FROM steps WHERE upper('ch' || channel) IN ('CH1', 'CH3') AND starts_with(CASE WHEN role = 'user' THEN 'expert_' || role ELSE role END, 'expert_') AND upper(gt_action) IN ('SPLIT', 'MERGE', 'DISCARD')""")
def human_action_rows(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("number", F.col("channel")).withColumn("channel", F.concat(F.lit("ch"), F.col("channel").cast("string")))
    rows = p.withColumn("source", F.when(F.col("role") == "user", F.concat(F.lit("expert_"), "role")).otherwise(F.col("role"))).withColumn("label_action", F.col("gt_action"))
    return datasets.human_actions(datasets.of_channels(rows, ["ch1", "CH3"], "expert_")).select(F.col("number").alias("channel"), "session", "step")


@query("""SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN -1 ELSE c_nationkey END AS nation, CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END AS segment FROM customer""")
def null_coerced(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") >= 5, F.col("c_nationkey")).alias("nation"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment"))
    return datasets.without_nulls(c)


@query("SELECT vec_id, round(list_max(CAST(embedding AS DOUBLE[])), 6) AS high, round(list_min(CAST(embedding AS DOUBLE[])), 6) AS low, CAST(list_position(CAST(embedding AS DOUBLE[]), list_max(CAST(embedding AS DOUBLE[]))) AS BIGINT) AS high_at, round((CAST(embedding[1] AS DOUBLE) - list_min(CAST(embedding AS DOUBLE[]))) / (list_max(CAST(embedding AS DOUBLE[])) - list_min(CAST(embedding AS DOUBLE[]))), 6) AS first_scaled, round(CAST(embedding[1] AS DOUBLE) - list_avg(CAST(embedding AS DOUBLE[])), 6) AS first_centred, 70 AS padded_size FROM embeddings")
def array_measures(spark, sf_dir):
    wf = F.col("embedding").cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", wf.alias("wf"))
    w = F.col("wf")
    e = arrays.extremes(w)
    return rows.select("vec_id", e.getField("high").alias("high"), e.getField("low").alias("low"), e.getField("high_at").alias("high_at"), F.get(arrays.rescaled(w), F.lit(0)).alias("first_scaled"), F.get(arrays.centred(w), F.lit(0)).alias("first_centred"), F.size(arrays.padded(w, 2, 4)).alias("padded_size"))


@query("SELECT lang, source, count(*) AS n, grouping(lang) + 2 * grouping(source) AS level FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def count_by_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n"), (F.grouping("lang") + 2 * F.grouping("source")).cast("bigint").alias("level"))


@query("""WITH k AS (SELECT DISTINCT c_nationkey AS k FROM customer UNION SELECT DISTINCT s_nationkey FROM supplier) SELECT k, k IN (SELECT c_nationkey FROM customer) AS in_left, k IN (SELECT s_nationkey FROM supplier) AS in_right FROM k""")
def key_sets(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).distinct().withColumn("in_left", F.lit(True))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).distinct().withColumn("in_right", F.lit(True))
    return a.join(b, "k", "full_outer").select("k", F.coalesce("in_left", F.lit(False)).alias("in_left"), F.coalesce("in_right", F.lit(False)).alias("in_right"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join_split(spark, sf_dir):
    split = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(split, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query(f"""WITH {SPIKES}, z AS (SELECT channel_id, cl, oc, count(*) AS n FROM spikes GROUP BY ALL) SELECT channel_id, cl, oc, n, CAST(row_number() OVER (PARTITION BY channel_id, cl ORDER BY n DESC, oc) AS INTEGER) AS rank FROM z""")
def overclusters_by_size(spark, sf_dir):
    sizes = spikes(spark, sf_dir).groupBy("channel_id", "cl", "oc").agg(F.count("*").alias("n"))
    return sizes.withColumn("rank", F.row_number().over(Window.partitionBy("channel_id", "cl").orderBy(F.desc("n"), "oc")))


@query("SELECT CAST(0 AS BIGINT) AS channel_id, CAST(c_nationkey + 1 AS BIGINT) AS cl, 'm 0 ' || (c_nationkey + 1) || ',\"few\"' AS line FROM customer GROUP BY c_nationkey HAVING count(*) < 60")
def action_log(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.lit(0).cast("bigint").alias("channel_id"), (F.col("c_nationkey") + 1).cast("bigint").alias("cl"))
    return curation.action_log(curation.size_filter(rows, 60).withColumn("reason", F.lit("few")))


@query("""SELECT o_orderkey, round((o_custkey % 900 * 2.0 + 50 * 8.0) / 1e6 * 4 * 200, 6) AS projected FROM orders""")
def budget_projection(spark, sf_dir):
    cost = text.cost(F.col("o_custkey") % 900, F.lit(0), F.lit(50), F.lit(2.0), F.lit(0.0), F.lit(8.0))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", cost.alias("avg_cost_usd"))
    return summaries.projected_budget(rows, 4, 200).select("o_orderkey", F.col("projected_cost_usd").alias("projected"))


@query()
def curation_pipeline(spark, sf_dir):
    s = spikes(spark, sf_dir)
    tree = merge_tree(s)
    return pipelines.curated(state.replayed(s, tree), tree, pipelines.by_purity(0.21), pipelines.by_dominant(), 50, 64, 70)


@query()
def student_evaluation(spark, sf_dir):
    s = spikes(spark, sf_dir)
    tree = merge_tree(s)
    return pipelines.student_predictions(state.replayed(s, tree), tree, lambda session, cluster: "KEEP" if session.size(cluster) % 2 else "SPLIT", 0.21)


@query(f"""WITH {SPIKES}, k0 AS (SELECT channel_id, cl FROM spikes GROUP BY ALL HAVING count(*) >= 58), f AS (SELECT s.channel_id, s.spike_id, s.t, CASE WHEN k0.cl IS NULL THEN 0 ELSE s.cl END AS cl FROM spikes s LEFT JOIN k0 USING (channel_id, cl)),
sz AS (SELECT channel_id, cl, count(*) AS n FROM f WHERE cl <> 0 GROUP BY ALL), p AS (SELECT a.channel_id, a.cl AS a, b.cl AS b, round(1.0 - abs(b.n - a.n) / 100.0, 9) AS corr FROM sz a JOIN sz b USING (channel_id) WHERE a.n < 68 AND b.n >= 68),
e AS (SELECT channel_id, a, b, UNNEST([a, b]) AS cl FROM p), i AS (SELECT e.channel_id, a, b, t - lag(t) OVER (PARTITION BY e.channel_id, a, b ORDER BY t) AS isi FROM f JOIN e ON f.channel_id = e.channel_id AND f.cl = e.cl), mi AS (SELECT channel_id, a, b, count(*) FILTER (isi < 3600.0) / (count(*) - 1) AS m FROM i GROUP BY ALL),
oi AS (SELECT channel_id, cl, t - lag(t) OVER (PARTITION BY channel_id, cl ORDER BY t) AS isi FROM f), r AS (SELECT channel_id, cl, CASE WHEN count(*) > 1 THEN count(*) FILTER (isi < 3600.0) / (count(*) - 1) ELSE 0 END AS r FROM oi GROUP BY ALL),
bp AS (SELECT p.*, m, row_number() OVER (PARTITION BY p.channel_id, p.a ORDER BY corr DESC, p.b) AS k FROM p JOIN mi USING (channel_id, a, b)),
act AS (SELECT sz.channel_id, sz.cl, CASE WHEN NOT (r > 0.1 AND n < 60) AND corr > 0.3 AND m < 0.17 THEN b ELSE 0 END AS new FROM sz JOIN r USING (channel_id, cl) LEFT JOIN bp ON bp.channel_id = sz.channel_id AND bp.a = sz.cl AND bp.k = 1 WHERE n < 68),
g AS (SELECT f.channel_id, f.spike_id, CASE WHEN act.cl IS NOT NULL THEN act.new ELSE f.cl END AS cl FROM f LEFT JOIN act ON act.channel_id = f.channel_id AND act.cl = f.cl), fin AS (SELECT channel_id, cl FROM g WHERE cl <> 0 GROUP BY ALL HAVING count(*) >= 75)
SELECT g.channel_id, g.spike_id, CAST(CASE WHEN fin.cl IS NULL THEN 0 ELSE g.cl END AS BIGINT) AS cl FROM g LEFT JOIN fin USING (channel_id, cl)""")
def heuristic_pipeline(spark, sf_dir):
    s = spikes(spark, sf_dir)
    sizes = matching.size_classes(curation.size_filtered(s, 58), 68)
    return pipelines.heuristic_labels(s, correlated(sizes), TREF, 58, 68, 75, most_isi=0.17, early_n=60).select("channel_id", "spike_id", "cl")


@query()
def training_pairs(spark, sf_dir):
    s = spikes(spark, sf_dir)
    pairs = matching.small_large_pairs(matching.size_classes(s, 70)).select("channel_id", "small", "large")
    return pipelines.training_pairs(s, expert_pairs(s, pairs), 70)
