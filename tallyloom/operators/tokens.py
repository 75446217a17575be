"""Token-level samples: truncation, masks, value broadcast, padding, clipped surrogate loss and divergence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship


def truncate_messages(turns: DataFrame, sample: str, order: str, length: str, role: str, most: int) -> DataFrame:
    """The rows of each sample from its earliest user turn on whose remaining lengths are `most` at most in sum, and `kept`, how much of
    each row's end stays.

    A sample within the bound stays whole. One without such a turn keeps its last `most`, of which the first row may be cut.
    """
    back = Window.partitionBy(sample).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    rest = turns.withColumn("_rest", F.sum(length).over(back))
    whole = Window.partitionBy(sample)
    starts = F.min(F.when((F.col(role) == "user") & (F.col("_rest") <= most), F.col(order))).over(whole)
    fits = F.max("_rest").over(whole) <= most
    placed = rest.withColumn("_start", F.when(fits, F.min(order).over(whole)).otherwise(starts))
    tail = F.greatest(F.lit(0), F.least(F.col(length), F.lit(most) - (F.col("_rest") - F.col(length))))
    kept = F.when(F.col("_start").isNull(), tail).when(F.col(order) >= F.col("_start"), F.col(length)).otherwise(0)
    placed = placed.withColumn("kept", kept.cast(turns.schema[length].dataType))
    return placed.filter((F.col("kept") > 0) | (F.col(order) >= F.col("_start"))).drop("_rest", "_start")


def last_user_message(messages: Column) -> Column:
    """The content of the last message of a user; empty without one."""
    return F.coalesce(F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(-1))["content"], F.lit(""))


def without_called_content(messages: Column) -> Column:
    """Messages (role, content, tool_calls) without the content of assistants' messages that come with tool calls."""
    called = lambda m: (m["role"] == "assistant") & (F.size(m["tool_calls"]) > 0)
    return F.transform(messages, lambda m: m.withField("content", F.when(~F.coalesce(called(m), F.lit(False)), m["content"])))


def truncate_ids(ids: Column, user_starts: Column, most: int) -> Column:
    """Token ids from the earliest user turn whose tail fits; the last `most` where none does. user_starts: places from 0."""
    n = F.size(ids)
    fitting = F.array_min(F.filter(user_starts, lambda s: n - s <= most))
    cut = F.coalesce(fitting, n - most)
    return F.when(n <= most, ids).otherwise(F.slice(ids, cut + 1, n - cut))


def _next(places: np.ndarray, at: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    """The first of the ascending places from `at` on, but `otherwise` at most."""
    if not len(places):
        return otherwise
    k = np.searchsorted(places, at)
    return np.where(k < len(places), np.minimum(places[np.minimum(k, len(places) - 1)], otherwise), otherwise)


def response_masks(ids: np.ndarray, ends: np.ndarray, start: list[int], end: int, newline: set[int], think: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(mask, segments) of all token ids of many samples, one after the other, given where each sample ends: 1 on the tokens of assistant turns, and the turn's number from 1.

    A turn begins with the marker `start` (two ids) with something after it; line feeds after it, and a think block (open, close) with its line feeds, don't count. It
    ends before the next `end`, or with the sample. A turn without tokens takes no number. A marker inside a turn that hasn't ended begins a turn of its own,
    to which the tokens from there on belong.
    """
    mask, segments = np.zeros(len(ids), dtype=np.int32), np.zeros(len(ids), dtype=np.int32)
    found = np.flatnonzero((ids[:-1] == start[0]) & (ids[1:] == start[1]))
    last = ends[np.searchsorted(ends, found, side="right")]
    found, last = found[found + 2 < last], last[found + 2 < last]
    if not len(found):
        return mask, segments
    words = np.flatnonzero(~np.isin(ids, list(newline)))
    begin = _next(words, found + 2, last)
    if think:
        opens = (begin < last) & (ids[np.minimum(begin, len(ids) - 1)] == think[0])
        close = _next(np.flatnonzero(ids == think[1]), begin, last)
        begin = np.where(opens & (close < last), _next(words, close + 1, last), begin)
    stop = _next(np.flatnonzero(ids == end), begin, last)
    full = stop > begin
    begin, stop, last = begin[full], stop[full], last[full]
    if not len(begin):
        return mask, segments
    turn = np.arange(len(begin)) - np.searchsorted(last, last) + 1  # numbered within the sample
    # a later turn takes its tokens from the turns before: of turns that end together, those that a later one covers are gone, and the others end where the next begins
    order = np.lexsort((np.arange(len(begin)), stop))
    rows = begin[order] + np.cumsum(np.diff(stop[order], prepend=stop[order][0]) > 0) * (len(ids) + 1)
    least = np.minimum.accumulate(rows[::-1])[::-1]
    kept = np.append(rows[:-1] < least[1:], True)
    order = order[kept]
    order = order[np.argsort(begin[order], kind="stable")]
    first, until, number = begin[order], stop[order], turn[order]
    until = np.minimum(until, np.append(first[1:], len(ids)))
    lengths = until - first
    places = np.repeat(first - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    mask[places] = 1
    segments[places] = np.repeat(number, lengths)
    return mask, segments


def with_response_mask(samples: DataFrame, ids_col: str, start: list[int], end: int, newline: set[int], think: tuple[int, int] | None = None) -> DataFrame:
    """Columns mask and segments of each sample's token ids (null as none), as response_masks has them, batch by batch in Arrow arrays."""
    ship(samples.sparkSession)

    @F.pandas_udf("mask array<int>, segments array<int>")
    def masked(ids: pd.Series) -> pd.DataFrame:
        rows = [np.asarray([] if x is None else x, dtype=np.int64) for x in ids]
        ends = np.cumsum([len(r) for r in rows])
        both = response_masks(np.concatenate(rows), ends, start, end, newline, think)
        return pd.DataFrame({n: pd.Series(np.split(v, ends[:-1]), dtype=object) for n, v in zip(("mask", "segments"), both, strict=True)})

    return samples.withColumn("_m", masked(ids_col)).select("*", "_m.mask", "_m.segments").drop("_m")


def user_starts(ids: Column, start: int, user: int) -> Column:
    """Where user turns begin in token ids, from 0: a start marker followed by the user's role."""
    places = F.sequence(F.lit(0), F.size(ids) - 2)
    return F.when(F.size(ids) > 1, F.filter(places, lambda i: (F.get(ids, i) == start) & (F.get(ids, i + 1) == user))).otherwise(F.array().cast("array<int>"))


def prepare_samples(samples: DataFrame, start: int, user: int, assistant: int, end: int, newline: set[int], think: tuple[int, int] | None = None, most: int = 8192, clip: float = 0.0) -> DataFrame:
    """Samples (ids, turn_advantages, turn_trainable) made ready for training, with the columns ids, mask, segments, advantages (one a token), truncated and outcome.

    Ids longer than most are cut to the earliest user turn whose tail fits, else to their end. Advantages are clipped, and the last of them go to the turns that are
    left. Without a list, or with an empty one, a sample has the one advantage 0; without turn_trainable all turns are trained on. outcome is kept, turn_mismatch (no turns, or
    more than advantages) or mask_empty (no turn that is left is trained on); what isn't kept has no advantages. Null ids count as none.
    """
    ids = F.coalesce("ids", F.array().cast(samples.schema["ids"].dataType))
    cut = F.when(F.size(ids) > most, truncate_ids(ids, user_starts(ids, start, user), most)).otherwise(ids) if most > 0 else ids
    rows = samples.withColumn("truncated", F.size(ids) > most if most > 0 else F.lit(False)).withColumn("ids", cut)
    rows = with_response_mask(rows, "ids", [start, assistant], end, newline, think)
    given = F.when(F.size("turn_advantages") > 0, F.col("turn_advantages")).otherwise(F.array(F.lit(0.0)))
    turns = F.coalesce(F.array_max("segments"), F.lit(0))
    rows = rows.withColumn("_values", align_turns(F.transform(given, lambda a: clipped(a, clip)), turns)).withColumn("_trained", align_turns(F.col("turn_trainable"), turns))
    rows = rows.withColumn("mask", trainable_mask(F.col("mask"), F.col("segments"), F.col("_trained")))
    outcome = F.when(F.col("_values").isNull(), "turn_mismatch").when(F.exists("mask", lambda m: m > 0), "kept").otherwise("mask_empty")
    rows = rows.withColumn("outcome", outcome).withColumn("advantages", F.when(F.col("outcome") == "kept", broadcast_turns(F.col("segments"), F.col("_values"), F.lit(0.0))))
    return rows.drop("_values", "_trained")


def preparation_counts(prepared: DataFrame) -> DataFrame:
    """One row: samples that are kept, truncated ones, those dropped for either reason, and the longest one kept."""
    n = lambda c, name: F.count_if(c).alias(name)
    outcome = F.col("outcome")
    longest = F.coalesce(F.max(F.when(outcome == "kept", F.size("ids"))), F.lit(0)).alias("max_tokens")
    return prepared.agg(n(outcome == "kept", "kept"), n(F.col("truncated"), "truncated"), n(outcome == "mask_empty", "mask_empty"), n(outcome == "turn_mismatch", "turn_mismatch"), longest)


def align_turns(values: Column, n_turns: Column) -> Column:
    """The last n_turns values, which truncation leaves; null where there are fewer values or no turns."""
    return F.when((n_turns > 0) & (F.size(values) >= n_turns), F.slice(values, -n_turns, n_turns))


def clipped(value: Column, most: float) -> Column:
    return F.greatest(F.lit(-most), F.least(F.lit(most), value)) if most > 0 else value


def broadcast_turns(segments: Column, values: Column, otherwise: Column) -> Column:
    """Each token's value: that of its segment, or `otherwise` in none. A segment beyond the values has none either."""
    return F.transform(segments, lambda s: F.when(s > 0, F.coalesce(F.get(values, s - 1), otherwise)).otherwise(otherwise))


def trainable_mask(mask: Column, segments: Column, trainable: Column) -> Column:
    """The mask with the tokens of turns that aren't trained on set to zero. Without a list (null) all turns are trained on; one that the list is too short for isn't."""
    masked = F.zip_with(mask, segments, lambda m, s: F.when((s > 0) & ~F.coalesce(F.get(trainable, s - 1), F.lit(False)), 0).otherwise(m))
    return F.when(trainable.isNull(), mask).otherwise(masked)


def token_rows(samples: DataFrame, key: str, arrays: list[str]) -> DataFrame:
    """One row for each token: key, pos from 0, and the arrays' elements."""
    zipped = samples.select(key, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "x"))
    return zipped.select(key, "pos", *(F.col(f"x.{a}").alias(a) for a in arrays))


def pad_right(samples: DataFrame, batch: str, column: str, value) -> DataFrame:
    """The arrays of each batch filled up to its longest one."""
    longest = F.max(F.size(column)).over(Window.partitionBy(batch))
    return samples.withColumn("_l", longest).withColumn(column, F.concat(column, F.array_repeat(F.lit(value), F.col("_l") - F.size(column)))).drop("_l")


def padding_stats(samples: DataFrame, batch: str, length: str) -> DataFrame:
    """For each batch: samples, longest, tokens, and the share of padding."""
    out = samples.groupBy(batch).agg(F.count("*").alias("n"), F.max(length).alias("max_len"), F.sum(length).alias("tokens"))
    return out.withColumn("pad_fraction", 1 - F.col("tokens") / (F.col("n") * F.col("max_len")))


def masked_mean(x: Column, mask: Column) -> Column:
    """Aggregate: sum(x * mask) / max(sum(mask), 1) over the tokens, not a mean of means."""
    return F.sum(x * mask) / F.greatest(F.sum(mask), F.lit(1))


def surrogate(log_p: Column, old_log_p: Column, advantage: Column, low: float = 0.2, high: float = 0.25, bound: float = 20.0) -> dict[str, Column]:
    """Token columns of the clipped surrogate loss: ratio, loss, clipped (the clipped term is the greater one, which depends on the advantage's sign), clipped_low, clipped_high and drift."""
    delta = clipped(log_p - old_log_p, bound)
    ratio = F.exp(delta)
    cut = F.greatest(F.lit(1 - low), F.least(F.lit(1 + high), ratio))
    return {
        "ratio": ratio,
        "loss": F.greatest(-advantage * ratio, -advantage * cut),
        "clipped": (-advantage * cut > -advantage * ratio).cast("double"),
        "clipped_low": (ratio < 1 - low).cast("double"),
        "clipped_high": (ratio > 1 + high).cast("double"),
        "drift": 0.5 * (log_p - old_log_p) * (log_p - old_log_p),
    }


def weighted_regression(log_p: Column, advantage: Column) -> Column:
    """The loss without old log probabilities."""
    return -advantage * log_p


def k3(log_p: Column, reference: Column, bound: float = 10.0) -> Column:
    """exp(d) - d - 1 with d = log_p - reference, bounded."""
    d = clipped(log_p - reference, bound)
    return F.exp(d) - d - 1


def loss_stats(tokens: DataFrame, group: str, beta: float = 0.0) -> DataFrame:
    """For each group of token rows (pos, mask, log_p, old_log_p, ref_log_p, advantage): masked means of the surrogate's
    parts, the divergence, and their total; where the total isn't finite, the loss alone, and 0 where that isn't either.
    The first token of a sample has no prediction and is left out."""
    parts = surrogate(F.col("log_p"), F.col("old_log_p"), F.col("advantage"))
    use = tokens.filter("pos > 0")
    aggregates = [masked_mean(c, F.col("mask")).alias(n) for n, c in parts.items()]
    out = use.groupBy(group).agg(*aggregates, masked_mean(k3(F.col("log_p"), F.col("ref_log_p")), F.col("mask")).alias("kl"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    total = F.col("loss") + beta * F.col("kl")
    return out.withColumn("total", F.when(finite(total), total).when(finite(F.col("loss")), F.col("loss")).otherwise(0.0))


def rank_shards(samples: DataFrame, index: str, world: int, score) -> DataFrame:
    """Scores computed shard by shard (index mod world) and merged by index: score takes and gives a pandas frame with the
    index. The result doesn't depend on the number of shards."""
    sharded = samples.withColumn("_shard", F.pmod(F.col(index), F.lit(world))).repartition(world, "_shard").drop("_shard")
    return sharded.mapInPandas(lambda it: (score(x) for x in it), f"{index} {samples.schema[index].dataType.simpleString()}, score double")
