"""Majority answers, accuracy and its breakdowns, and summaries of agents and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import category_prefix, normal_answer, unboxed
from .rewards import group_quantiles


def majority(rows: DataFrame, group: str, prediction: str, order: str) -> DataFrame:
    """(group, prediction, votes): the commonest prediction that isn't null, of several the one seen first by order;
    null where a group has none. Counts combine on the map side before the few candidates of a group meet."""
    counted = rows.groupBy(group, prediction).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    best = F.max(F.when(F.col(prediction).isNotNull(), F.struct("_n", (-F.col("_first")).alias("_f"), F.col(prediction).alias("p"))))
    return counted.groupBy(group).agg(best.alias("b")).select(group, F.col("b.p").alias(prediction), F.coalesce("b._n", F.lit(0)).alias("votes"))


def scored_records(predictions: DataFrame, gold: DataFrame, key: str, prediction: str = "prediction", answer: str = "answer", mode: str = "letter") -> DataFrame:
    """Predictions with gold answers and columns matched, has_gold, has_prediction, scored and correct.

    In mode letter texts are compared in upper case, and what has no gold, or an empty one, isn't scored. In mode boxed gold is the inside of its box and both sides are
    compared as free answers; no gold counts as an empty one. What has no match isn't scored; what has no prediction is scored as wrong.
    """
    if mode not in ("letter", "boxed"):
        raise ValueError(f"no such mode: {mode}")
    known = gold.withColumn("_known", F.lit(True))
    joined = predictions.join(known, key, "left")
    matched = F.coalesce("_known", F.lit(False))
    given, wanted = F.col(prediction), F.col(answer)
    if mode == "boxed":
        has_gold = F.lit(True)
        given, wanted = normal_answer(given), normal_answer(unboxed(F.coalesce(wanted, F.lit(""))))
    elif isinstance(gold.schema[answer].dataType, StringType):
        has_gold = wanted.isNotNull() & (wanted != "")
        given, wanted = F.upper(given), F.upper(wanted)
    else:
        has_gold = wanted.isNotNull()
    out = joined.withColumn("matched", matched).withColumn("has_gold", F.col("matched") & has_gold).withColumn("has_prediction", F.col(prediction).isNotNull())
    out = out.withColumn("scored", F.col("has_gold"))
    return out.withColumn("correct", F.coalesce(F.col("scored") & (given == wanted), F.lit(False))).drop("_known")


def record_category(category: Column, depth: int = 2) -> Column:
    """A record's category for breakdowns: the gold row's path to a depth, `unknown` without one."""
    return F.coalesce(category_prefix(category, depth), F.lit("unknown"))


def scoring_counters(records: DataFrame) -> DataFrame:
    """One row: n, n_no_match, n_no_gold, n_no_pred, n_scored, n_correct, accuracy (0 where nothing is scored)."""
    n = lambda c, name: F.count_if(c).alias(name)
    out = records.agg(
        F.count("*").alias("n"), n(~F.col("matched"), "n_no_match"), n(F.col("matched") & ~F.col("has_gold"), "n_no_gold"),
        n(F.col("scored") & ~F.col("has_prediction"), "n_no_pred"), n(F.col("scored"), "n_scored"), n(F.col("correct"), "n_correct"),
    )
    return out.withColumn("accuracy", F.coalesce(F.try_divide("n_correct", "n_scored"), F.lit(0.0)))


def accuracy_rollup(records: DataFrame, by: str) -> DataFrame:
    """Scored records, correct ones and accuracy for each value of by, and in one row with is_total for all."""
    rolled = records.filter("scored").rollup(by).agg(F.count("*").alias("n_scored"), F.count_if("correct").alias("n_correct"), (F.grouping(by) == 1).alias("is_total"))
    return rolled.withColumn("accuracy", F.col("n_correct") / F.col("n_scored"))


#: Exits that end a participant's part as planned.
NORMAL_EXITS = ("session_end", "max_rounds")
_SUMS = ("rounds", "successful_rounds", "failed_rounds", "llm_calls", "posts_created", "comments_created", "votes_cast", "total_prompt_tokens", "total_completion_tokens", "llm_errors", "api_errors", "no_tool_responses", "fallback_parses")


def experiment_summary(results: DataFrame) -> DataFrame:
    """One row: agents, sums of their counters, normal exits, and a map of exit reasons to counts."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS if c in results.columns]
    totals = results.agg(F.count("*").alias("agents"), *sums, F.count_if(F.col("exit_reason").isin(*NORMAL_EXITS)).alias("normal_exits"))
    reasons = results.groupBy(F.coalesce("exit_reason", F.lit("unknown")).alias("exit_reason")).agg(F.count("*").alias("n"))
    histogram = reasons.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("exit_reason", "n")))).alias("exit_reasons"))
    return totals.crossJoin(histogram)  # one row each


def compare_policies(rows: DataFrame, tag: str = "tag", reward: str = "reward", advantage: str = "advantage") -> DataFrame:
    """For each tag: samples, mean reward, share of positive rewards in per cent, mean and mean absolute advantage, and its p10 and p90 by index."""
    means = rows.groupBy(tag).agg(
        F.count("*").alias("n_samples"), F.avg(reward).alias("reward_mean"), (F.avg((F.col(reward) > 0).cast("int")) * 100).alias("reward_pos_pct"),
        F.avg(advantage).alias("advantage_mean"), F.avg(F.abs(advantage)).alias("advantage_abs_mean"),
    )
    q = group_quantiles(rows, [tag], advantage, [0.1, 0.9]).select(F.col(tag).alias("_tag"), F.col("q0").alias("advantage_p10"), F.col("q1").alias("advantage_p90"))
    return means.join(q, F.col(tag).eqNullSafe(F.col("_tag")), "left").drop("_tag")


def sweep_summary(reports: dict[str, DataFrame]) -> DataFrame:
    """One row for each cell of a sweep, in the order of their names: the union of the cells' one-row reports."""
    out = None
    for cell, report in sorted(reports.items()):
        part = report.select(F.lit(cell).alias("cell"), *report.columns)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.orderBy("cell")


def mean_posts(sessions: DataFrame, posts: str = "posts") -> DataFrame:
    return sessions.agg(F.sum(F.size(posts)).alias("n_posts"), F.avg(F.size(posts)).alias("mean_posts"))


def run_status(done: Column, failed: Column, failed_iteration: Column, explicit: Column, last_seen: Column, now: Column, stale_hours: float = 24) -> Column:
    """completed, failed@N (failed alone where the iteration isn't known), what the state says, stale, or running, in this order."""
    idle = (F.unix_timestamp(now) - F.unix_timestamp(last_seen)) / 3600
    return (
        F.when(done, "completed")
        .when(failed, F.concat_ws("@", F.lit("failed"), F.nullif(F.substring_index(failed_iteration.cast("string"), "/", 1), F.lit(""))))
        .when(explicit.isNotNull() & (explicit != ""), explicit)
        .when(idle > stale_hours, "stale")
        .otherwise("running")
    )


def surplus(rows: DataFrame, group: str, order: str, keep: int) -> DataFrame:
    """All rows of a group but the `keep` most recent ones."""
    from pyspark.sql import Window

    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.col(order).desc()))).filter(F.col("_r") > keep).drop("_r")


# The tools in the order in which a round runs them.
TOOL_RANK = {"python_exec": 0, "vote": 1, "submit": 2, "wait": 3, "leave": 3}


def tool_order(name: Column) -> Column:
    """Where a tool call stands in a round; unknown tools come last. Ties keep their order in the message."""
    out = F.lit(99)
    for tool, rank in TOOL_RANK.items():
        out = F.when(name == tool, rank).otherwise(out)
    return out
