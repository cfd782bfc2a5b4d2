"""Text of decisions: the action language, tolerant JSON, extraction of actions, casts, usage and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIONS = ["NOT_MERGE", "MERGE", "SPLIT", "DISCARD", "KEEP"]


def parsed_action(text: Column, strict: bool = True) -> Column:
    """Struct (action, cluster_id, target_id) of `s N`, `m T S` or `m 0 N`; null if it is none. strict: nothing follows."""
    end = r"\s*$" if strict else ""
    plain = F.regexp_replace(F.trim(text), r"^['\"]+|['\"]+$", "")
    number = r"(\d+)(?:\.0+)?"
    split, merge = rf"^s\s+{number}{end}", rf"^m\s+{number}\s+{number}{end}"
    one = F.regexp_extract(plain, split, 1).try_cast("bigint")
    first, second = F.regexp_extract(plain, merge, 1).try_cast("bigint"), F.regexp_extract(plain, merge, 2).try_cast("bigint")
    none = F.lit(None).cast("bigint")

    def made(action: str, cluster: Column, target: Column) -> Column:
        return F.struct(F.lit(action).alias("action"), cluster.alias("cluster_id"), target.alias("target_id"))

    return F.when(one.isNotNull(), made("split", one, none)).when(first == 0, made("discard", second, none)).when(first.isNotNull(), made("merge", second, first))


def compact(text: Column, limit: int = 220) -> Column:
    """White space squeezed to single spaces, cut to `limit` with dots at the end."""
    s = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.substring(s, 1, limit - 3), F.lit("...")))


#: A JSON string, escapes and all; what is replaced outside strings is matched after it.
_STRING = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")'


def json_object(text: Column) -> Column:
    """The JSON object a text holds from its first brace on, as strict JSON; null if that is not one.

    Line comments and commas before a closing bracket go, but never within strings, so URLs survive. The engine's own
    parser finds the end of the object; fences and words around it are never read.
    """
    tail = F.regexp_extract(text, r"(?s)\{.*", 0)
    for noise in (r"//[^\r\n]*", r",(?=\s*[\]}])"):
        tail = F.regexp_replace(tail, f"(?s){_STRING}|{noise}", "$1")
    return F.get_json_object(tail, "$")


#: How answers name their action, anywhere or within their last lines, and the words for none.
NAMED_ANYWHERE = [r"ACTION\s*:\s*([A-Z_]+)", r"<\s*ACTION\s*>\s*([A-Z_]+)\s*<\s*/\s*ACTION\s*>"]
NAMED_AT_END = [r"(?:FINAL\s+ANSWER|FINAL\s+ACTION|ANSWER|ACTION)\s*[:：]\s*([A-Z_]+)", r"(?m)^\s*([A-Z_]+)\s*$"]
END_LINES, INVALID, UNREADABLE = 8, "INVALID_ACTION", "PARSE_ERROR"


def extracted_action(text: Column, allowed: list[str]) -> Column:
    """The action an answer takes: the first of its readings, from the answer itself to its last lines, that is allowed.

    An action of another phase counts as INVALID_ACTION, but only from the last lines; no action at all is PARSE_ERROR.
    """
    answer = F.upper(F.btrim(F.coalesce(text, F.lit(""))))
    ending = F.array_join(F.reverse(F.slice(F.reverse(F.split(answer, r"\R")), 1, END_LINES)), "\n")
    in_json = F.upper(F.btrim(F.get_json_object(json_object(text), "$.action")))
    anywhere = [answer, in_json, *(F.regexp_extract(answer, p, 1) for p in NAMED_ANYWHERE)]
    at_end = [F.regexp_extract(ending, p, 1) for p in NAMED_AT_END]
    mentioned = F.regexp_like(ending, F.lit(rf"\b({'|'.join(ACTIONS)})\b"))
    return F.coalesce(
        *(F.when(found.isin(allowed), found) for found in anywhere),
        *(F.when(found.isin(allowed), found).when(found.isin(ACTIONS), INVALID) for found in at_end),
        F.when(mentioned, INVALID),
        F.lit(UNREADABLE),
    )


def decided(action: Column, phase: int) -> Column:
    """The action of a phase, its default where there is none: DISCARD in phase 1, NOT_MERGE in phase 2."""
    allowed, default = (["KEEP", "DISCARD", "SPLIT"], "DISCARD") if phase == 1 else (["MERGE", "NOT_MERGE", "DISCARD"], "NOT_MERGE")
    return F.when(action.isin(allowed), action).otherwise(default)


def number(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(default))


def unit_score(text: Column) -> Column:
    """A score clipped to [0, 1]; 0.5 where it cannot be read."""
    score = text.try_cast("double")
    return F.when(score.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


USAGE_PATHS = {
    "input_tokens": ["$.input_tokens", "$.prompt_tokens"],
    "cached_input_tokens": ["$.input_tokens_details.cached_tokens", "$.prompt_tokens_details.cached_tokens"],
    "output_tokens": ["$.output_tokens", "$.completion_tokens"],
    "reasoning_output_tokens": ["$.output_tokens_details.reasoning_tokens", "$.completion_tokens_details.reasoning_tokens"],
    "total_tokens": ["$.total_tokens"],
}


def usage(json: Column) -> Column:
    """Struct of token counts from either shape of a usage record; uncached input is never negative."""
    got = {name: F.coalesce(*(F.get_json_object(json, p).try_cast("bigint") for p in paths), F.lit(0)) for name, paths in USAGE_PATHS.items()}
    total = F.when(got["total_tokens"] > 0, got["total_tokens"]).otherwise(got["input_tokens"] + got["output_tokens"])
    uncached = F.greatest(got["input_tokens"] - got["cached_input_tokens"], F.lit(0))
    return F.struct(*(got[k].alias(k) for k in ("input_tokens", "cached_input_tokens")), uncached.alias("uncached_input_tokens"), *(got[k].alias(k) for k in ("output_tokens", "reasoning_output_tokens")), total.alias("total_tokens"))


def cost(uncached: Column, cached: Column, output: Column, price: Column, cached_price: Column, output_price: Column) -> Column:
    """US dollars at prices a million tokens."""
    return (uncached * price + cached * cached_price + output * output_price) / 1e6


def mean_std_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines `name: mean ± std` as rows name, mean, std."""
    pattern = r"^\s*([^:]+?)\s*:\s*(-?[\d.]+)\s*±\s*(-?[\d.]+)"
    name, mean, std = (F.regexp_extract(column, pattern, i) for i in (1, 2, 3))
    return lines.where(F.regexp_like(column, F.lit(pattern))).select(name.alias("name"), mean.cast("double").alias("mean"), std.cast("double").alias("std"))


def examples(steps: DataFrame) -> DataFrame:
    """Instruction, input and output of each step that is not KEEP."""
    target = F.when(F.col("target_id").isNotNull(), F.concat(F.lit(" with cluster "), F.col("target_id").cast("string"))).otherwise("")
    return steps.where("gt_action <> 'KEEP'").select(
        *[c for c in ("session", "step") if c in steps.columns],
        F.concat(F.lit("Choose the curation action for cluster "), F.col("cluster_id").cast("string"), F.lit(".")).alias("instruction"),
        F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"), F.lit(" has "), F.col("n_spikes").cast("string"), F.lit(" events"), target, F.lit(".")).alias("input"),
        F.concat(F.lit("Action: "), F.col("gt_action"), F.lit("\nReason: "), F.coalesce("gt_reasoning", F.lit(""))).alias("output"),
    )


def chat(rows: DataFrame) -> DataFrame:
    """Prompt and answer as an array of messages."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return rows.withColumn("messages", F.array(message("user", "prompt"), message("assistant", "answer")))



def cluster_prompt(n_spikes: Column, isi_rate: Column, amplitude_cv: Column, n_overclusters: Column) -> Column:
    """The question of phase 1 about one cluster, from its metrics."""
    form = "Cluster of %d events: %.4f of its intervals violate the refractory time, amplitude CV %.4f, %d fine labels. Answer KEEP, DISCARD or SPLIT."
    return F.format_string(form, n_spikes, isi_rate, amplitude_cv, n_overclusters)


def merge_prompt(n_small: Column, n_large: Column, correlation: Column, merged_isi: Column) -> Column:
    """The question of phase 2 about a small and a large cluster."""
    form = "Clusters of %d and %d events correlate at %.4f; together %.4f of their intervals violate the refractory time. Answer MERGE, NOT_MERGE or DISCARD."
    return F.format_string(form, n_small, n_large, correlation, merged_isi)


#: What a teacher looks at first, by style.
CRITERIA = {"strict": "Weigh contamination first.", "lenient": "Weigh lost events first.", "balanced": "Weigh contamination and lost events alike."}


def criteria(style: Column) -> Column:
    out = F.lit(CRITERIA["balanced"])
    for name, words in CRITERIA.items():
        out = F.when(F.lower(style) == name, words).otherwise(out)
    return out
