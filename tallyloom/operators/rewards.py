"""Rewards from judges' votes, position debiasing, and group-normalised advantages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import running_sums

#: A slope is fitted over sessions with so many posts, and used if so steep.
FIT_POSTS, LEAST_SLOPE, LEAST_SPREAD = 4, 0.01, 1e-9


def post_rewards(posts: DataFrame, votes: DataFrame) -> DataFrame:
    """Posts with reward: the sum of judges' current votes, 0.0 without any; votes of others and on comments don't count."""
    judged = votes.filter("voter_role = 'judge' and target_type = 'post'").groupBy(F.col("target_id").alias("post_id")).agg(F.sum("value").alias("sum_value"))
    return posts.join(judged, "post_id", "left").withColumn("reward", F.coalesce(F.col("sum_value").cast("double"), F.lit(0.0))).drop("sum_value")


def with_positions(posts: DataFrame, group: str = "session_id", order: str = "post_id") -> DataFrame:
    """Column t: the post's place in its session, from 0 to 1; 0 for a single post. n_posts: the session's posts."""
    ordered = Window.partitionBy(group).orderBy(order)
    n = F.count("*").over(Window.partitionBy(group))
    return posts.withColumn("n_posts", n).withColumn("t", (F.row_number().over(ordered) - 1) / F.greatest(F.col("n_posts") - 1, F.lit(1)))


def position_slope(rewards: DataFrame) -> DataFrame:
    """One row, slope: of reward on t by least squares over sessions of FIT_POSTS posts or more; 0 where it can't be fitted."""
    fit = rewards.filter(F.col("n_posts") >= FIT_POSTS).agg(F.count("*").alias("n"), F.regr_slope("reward", "t").alias("b"), F.regr_sxx("reward", "t").alias("sxx"))
    ok = (F.col("n") >= FIT_POSTS) & (F.col("sxx") >= LEAST_SPREAD)
    return fit.select(F.when(ok, F.coalesce("b", F.lit(0.0))).otherwise(0.0).alias("slope"))


def debias_position(rewards: DataFrame) -> DataFrame:
    """Column debiased: the reward less slope * (t - 0.5), or the reward itself where the slope is negligible."""
    joined = rewards.crossJoin(F.broadcast(position_slope(rewards)))  # one row
    shift = F.col("slope") * (F.coalesce("t", F.lit(0.5)) - 0.5)
    return joined.withColumn("debiased", F.when(F.abs("slope") < LEAST_SLOPE, F.col("reward")).otherwise(F.col("reward") - shift)).drop("slope")


def _number(option) -> float | None:
    try:
        return float(option)
    except (TypeError, ValueError):
        return None


def advantages(rewards: DataFrame, baseline="mean_session", scale="session_std", group: str = "session_id", value: str = "debiased") -> DataFrame:
    """Column advantage: (value - baseline) / scale.

    baseline: mean_session, mean_global, a number or its text; anything else, or None for a missing option, is 0.
    scale: session_std, global_std (population deviations, 1 at least, and 1 for a single row), none, a number or its
    text, taken as it is; None for a missing option is session_std, and any other text 1. A scale of zero is an error.
    """
    x, own, whole = F.col(value), Window.partitionBy(group), None
    if baseline == "mean_global" or scale == "global_std":
        whole = rewards.agg(F.avg(value).alias("_mean"), F.count(value).alias("_n"), F.stddev_pop(value).alias("_std"))
        rewards = rewards.crossJoin(F.broadcast(whole))  # one row
    if baseline == "mean_session":
        base: Column = F.avg(x).over(own)
    elif baseline == "mean_global":
        base = F.col("_mean")
    else:
        base = F.lit(_number(baseline) or 0.0)
    deviation = lambda n, std: F.when(n <= 1, 1.0).otherwise(F.greatest(std, F.lit(1.0)))
    if scale in (None, "session_std"):
        by = deviation(F.count(x).over(own), F.stddev_pop(x).over(own))
    elif scale == "global_std":
        by = deviation(F.col("_n"), F.col("_std"))
    elif scale == "none":
        by = F.lit(1.0)
    else:
        number = _number(scale)
        if number == 0:
            raise ZeroDivisionError("a scale of zero")
        by = F.lit(1.0 if number is None else number)
    return rewards.withColumn("advantage", (x - base) / by).drop("_mean", "_n", "_std")


def group_quantiles(rows: DataFrame, group: list[str], value: str, shares: list[float]) -> DataFrame:
    """(group, q0, q1, ...): for each group the elements int(p * (n - 1)) of its n sorted values that aren't null, as they stand in the list.

    The counts of a group's distinct values are summed up over ranges of (group, value), so a group that holds most rows is selected from by many tasks.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ends = running_sums(counts, group, ["_v"], "_n", "_end")
    totals = counts.groupBy(*group).agg(F.sum("_n").alias("_total"))
    if group:
        ends = ends.alias("e").join(totals.alias("t"), [F.col(f"e.{c}").eqNullSafe(F.col(f"t.{c}")) for c in group]).select("e.*", "_total")
    else:
        ends = ends.crossJoin(F.broadcast(totals))  # one row
    want = [F.floor(F.lit(p) * (F.col("_total") - 1)) for p in shares]
    picked = [F.max(F.when((F.col("_end") > w) & (F.col("_end") - F.col("_n") <= w), F.col("_v"))).alias(f"q{k}") for k, w in enumerate(want)]
    return ends.groupBy(*group).agg(*picked)


def indexed_quantiles(rows: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """One row, q0, q1, ...: the elements int(p * (n - 1)) of all sorted values, without gathering them; null where there are none."""
    one = rows.select(F.lit(0).alias("_all"), value)
    return group_quantiles(one, ["_all"], value, shares).agg(*(F.max(f"q{k}").alias(f"q{k}") for k in range(len(shares))))


def reward_metrics(rows: DataFrame, reward: str = "reward", advantage: str = "advantage") -> DataFrame:
    """One row: n_samples, means, share of positive rewards in per cent, mean absolute advantage, p10 and p90 by index."""
    q = indexed_quantiles(rows, advantage, [0.1, 0.9])
    base = rows.agg(
        F.count("*").alias("n_samples"), F.avg(reward).alias("reward_mean"), (F.avg((F.col(reward) > 0).cast("int")) * 100).alias("reward_pos_pct"),
        F.avg(advantage).alias("advantage_mean"), F.avg(F.abs(advantage)).alias("advantage_abs_mean"),
    )
    return base.crossJoin(q.select(F.col("q0").alias("advantage_p10"), F.col("q1").alias("advantage_p90")))  # one row each
