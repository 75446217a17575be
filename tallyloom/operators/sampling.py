"""Deterministic draws, splits, schedules, batches and shards: a hash of seed and key takes a random generator's place."""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.templates import hash_number
from .running import numbered, running_sums


def draw_order(seed: str, key: Column) -> Column:
    """A number to order by for a shuffle: the same for the same seed and key."""
    return hash_number(F.concat(F.lit(seed + ":"), key.cast("string")))


def stratified_train(pool: DataFrame, key: str, stratum: str, seed: str, divisor: int = 10) -> DataFrame:
    """Of each stratum max(1, n div divisor) rows, drawn by hash. A stratum that holds most rows is numbered by many tasks; rows without one are a stratum too."""
    drawn = running_sums(pool.withColumn("_draw", draw_order(seed, F.col(key))).withColumn("_one", F.lit(1)), [stratum], ["_draw", key], "_one", "_place")
    sizes = pool.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_n"))
    sized = drawn.join(sizes, F.col(stratum).eqNullSafe(F.col("_s")))
    return sized.filter(F.col("_place") <= F.greatest(F.lit(1), F.floor(F.col("_n") / divisor))).select(*pool.columns)


def uniform_test(pool: DataFrame, train: DataFrame, key: str, stratum: str, seed: str, size: int) -> DataFrame:
    """Of what isn't in train one row of a stratum at most, from strata drawn by hash until there are `size` rows."""
    rest = pool.join(train.select(key), key, "left_anti")
    first = rest.withColumn("_d", draw_order(seed, F.col(key))).groupBy(stratum).agg(F.min_by(F.struct(*pool.columns), F.struct("_d", key)).alias("row"))
    return first.orderBy(draw_order(seed + ":stratum", F.col(stratum)), stratum).limit(size).select("row.*")


def disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row, n_common: keys in both tables; 0 where they are disjoint."""
    return a.select(key).distinct().join(b.select(key), key, "left_semi").agg(F.count("*").alias("n_common"))


def draw_schedule(pool: DataFrame, key: str, seed: str, n: int, batch: int) -> DataFrame:
    """n rows drawn without replacement, with their place from 0 and their batch; an error if the pool is smaller."""
    if (size := pool.count()) < n:
        raise ValueError(f"{n} rows drawn from {size}")
    chosen = pool.orderBy(draw_order(seed, F.col(key)), key).limit(n)
    place = F.row_number().over(Window.orderBy(draw_order(seed, F.col(key)), key)) - 1  # n rows
    return chosen.withColumn("place", place).withColumn("batch", F.floor(F.col("place") / batch).cast("int"))


def first_seen_ids(rows: DataFrame, group: str, item: str, order: str) -> DataFrame:
    """(group, item, local_id): items numbered from 1 in the order in which a group first shows them."""
    first = rows.groupBy(group, item).agg(F.min(order).alias("_first"))
    numbered_ = running_sums(first.withColumn("_one", F.lit(1)), [group], ["_first", item], "_one", "local_id")  # a hot group is numbered by many tasks
    return numbered_.drop("_first", "_one")


def iterations(schedule: DataFrame, epochs: int, rounds: int, round_col: str = "round") -> DataFrame:
    """Each row of a schedule, which has its round from 0, once for each epoch from 1, with the iteration from 1 in which it comes."""
    each = schedule.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(epochs).cast("long"))))
    return each.withColumn("iteration", ((F.col("epoch") - 1) * rounds + F.col(round_col) + 1).cast("long"))


def permuted(k: Column, n: int, key: Column) -> Column:
    """Where a permutation of 0..n-1, drawn by key, takes k: the k-th pick of a draw without replacement, known without the other picks.

    A Feistel network over the smallest rectangle of n cells or more permutes its cells; from a cell beyond n it goes on until it is below. The rectangle has
    less than a root of n cells beyond, and no walk is longer than those.
    """
    rows = math.isqrt(max(1, n) - 1) + 1
    columns = -(-n // rows)
    number = lambda i, x: hash_number(F.concat_ws(":", key, i.cast("string"), x.cast("string")))

    def mixed(at: Column) -> Column:
        begin = F.struct(F.floor(at / columns).cast("long").alias("l"), F.pmod(at, F.lit(columns)).cast("long").alias("r"))
        left = lambda c, i: F.struct(F.pmod(c["l"] + number(i, c["r"]), F.lit(rows)).cast("long").alias("l"), c["r"].alias("r"))
        right = lambda c, i: F.struct(c["l"].alias("l"), F.pmod(c["r"] + number(i, c["l"]), F.lit(columns)).cast("long").alias("r"))
        steps = F.array(*(F.lit(i) for i in range(4)))
        return F.aggregate(steps, begin, lambda c, i: F.when(i % 2 == 0, left(c, i)).otherwise(right(c, i)), lambda c: c["l"] * columns + c["r"])

    beyond = rows * columns - n
    out = mixed(k.cast("long"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(beyond)), out, lambda v, _: F.when(v >= n, mixed(v)).otherwise(v)) if beyond else out


def cast_names(sessions: DataFrame, pool: DataFrame, seed_col: str, prefix: str = "name", actors: int = 32, judges: int = 32) -> DataFrame:
    """(session_id, name, alias): for each session a draw from the pool of distinct names (alias) without replacement; the first go to
    Scientist_1.., the next to Judge_1... A pool that is too small gives all its names.

    A session's picks are places in the ordered pool, worked out for it alone and joined by number: the rows made are those that are returned.
    """
    names = numbered(pool.select("alias"), ["alias"], "_number")
    n = names.count()
    if not n:
        return sessions.select("session_id", F.lit("").alias("name"), F.lit("").alias("alias")).limit(0)
    picks = sessions.select("session_id", seed_col, F.explode(F.sequence(F.lit(0), F.lit(min(actors + judges, n) - 1))).alias("_k"))
    key = F.concat(F.lit(prefix + ":"), F.col(seed_col).cast("string"))
    placed = picks.withColumn("_number", permuted(F.col("_k"), n, key)).join(names, "_number")
    name = F.when(F.col("_k") < actors, F.concat(F.lit("Scientist_"), F.col("_k") + 1)).otherwise(F.concat(F.lit("Judge_"), F.col("_k") - actors + 1))
    return placed.select("session_id", name.alias("name"), "alias")


def persona(key: Column, role: Column, slot: Column, pool: list[str], most: int = 32) -> Column:
    """The slot's persona in a draw of at most so many from the pool for (key, role); null for a slot outside it."""
    if not pool:
        return F.lit(None).cast("string")
    drawn = permuted(slot, len(pool), F.concat_ws(":", key.cast("string"), role))
    return F.when((slot >= 0) & (slot < min(len(pool), most)), F.element_at(F.array(*map(F.lit, pool)), (drawn + 1).cast("int")))


def shuffled_choices(row_key: Column, right: Column, wrong: list[Column], seed: str) -> Column:
    """struct<choices array<string>, letter>: the choices in an order drawn for the row, and the right one's letter."""
    listed = F.array(F.struct(F.lit(True).alias("ok"), right.alias("text"), F.lit(0).alias("k")), *(F.struct(F.lit(False).alias("ok"), w.alias("text"), F.lit(k + 1).alias("k")) for k, w in enumerate(wrong)))
    hashed = F.array_sort(F.transform(listed, lambda c: F.struct(hash_number(F.concat_ws(":", F.lit(seed), row_key.cast("string"), c["k"].cast("string"))).alias("h"), c["k"].alias("k"), c["ok"].alias("ok"), c["text"].alias("text"))))
    texts = F.transform(hashed, lambda c: c["text"])
    place = F.array_position(F.transform(hashed, lambda c: c["ok"]), F.lit(True))
    return F.struct(texts.alias("choices"), F.substring(F.lit("ABCDEFGH"), place.cast("int"), F.lit(1)).alias("letter"))


def length_batches(samples: DataFrame, key: str, length: str, batch: int, seed: str, epoch: int = 0) -> DataFrame:
    """Samples sorted by length in batches, with the order in which the epoch takes the batches (`turn`).

    The places by length come from counts of range partitions, so no task sorts all samples; rows that tie in length and key, and null lengths, which come
    first, stay too.
    """
    placed = numbered(samples, [length, key], "_place").withColumn("batch", F.floor(F.col("_place") / batch).cast("long")).drop("_place")
    return placed.withColumn("turn", hash_number(F.concat_ws(":", F.lit(seed), F.lit(epoch), F.col("batch").cast("string"))))


def round_robin(rows: DataFrame, place: str, world: int) -> DataFrame:
    """Column shard: place mod world, for places numbered from 0."""
    return rows.withColumn("shard", F.pmod(F.col(place), F.lit(world)).cast("int"))


def python_choice(rows: DataFrame, seed_text: str, pool: list[str], out_col: str = "choice") -> DataFrame:
    """The pick that Python's random.Random(seed text).choice(pool) makes, for bit parity with runs seeded that way."""

    @F.pandas_udf("string")
    def choose(seeds: pd.Series) -> pd.Series:
        return pd.Series([random.Random(s).choice(pool) for s in seeds])

    return rows.withColumn(out_col, choose(F.col(seed_text)))
