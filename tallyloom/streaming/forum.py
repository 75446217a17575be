"""Streaming forms: vote folds, runs over arriving files, fan-out, sessions of activity and event windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.relational import deliveries


def parquet_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


class Fold(NamedTuple):
    """A stream whose state lies in tables: step(rows, number, folder) works a micro-batch out by joins and windows from its rows and from what earlier ones have
    left below folder, and result(spark, folder) reads what all of them have come to.

    Micro-batches write under their number and read only lower ones, so one that runs again replaces itself.
    """

    rows: DataFrame
    step: Callable[[DataFrame, int, str], None]
    result: Callable[[SparkSession, str], DataFrame]


def keep(df: DataFrame, folder: str, name: str, number: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")


def kept(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """What all micro-batches have kept, with the number of the batch."""
    return spark.read.schema(f"{schema}, batch int").parquet(f"{folder}/{name}")


def fold_votes(votes: DataFrame) -> Fold:
    """A stream of votes (voter, target_type, target_id, value, vote_id) as its changes: for each key of a micro-batch the
    new value with the one before. State is the last vote of each key of each micro-batch; rows of a batch are put in order by vote_id, and
    votes that are not newer than the state are passed over, so replays change nothing."""
    key, kinds = ["voter", "target_type", "target_id"], {f.name: f.dataType.simpleString() for f in votes.schema}
    schema = f"voter {kinds['voter']}, target_type string, target_id {kinds['target_id']}, value long, previous_value long, vote_id long"

    def step(rows: DataFrame, number: int, folder: str) -> None:
        cast = rows.select(*key, F.col("value").cast("long").alias("value"), F.col("vote_id").cast("long").alias("vote_id"), F.lit(True).alias("_new"))
        if number:
            last = kept(rows.sparkSession, folder, "votes", f"{schema}, last boolean").filter((F.col("batch") < number) & F.col("last"))
            cast = cast.union(last.groupBy(*key).agg(F.max_by("value", "vote_id"), F.max("vote_id")).withColumn("_new", F.lit(False)))
        seen = F.coalesce(F.max(F.when(~F.col("_new"), F.col("vote_id"))).over(Window.partitionBy(*key)), F.lit(-1)) if number else F.lit(-1)
        by = Window.partitionBy(*key).orderBy("vote_id", "_new")
        newer = cast.withColumn("_seen", seen).filter(~F.col("_new") | (F.col("vote_id") > F.col("_seen"))).withColumn("_before", F.lag("vote_id").over(by))
        changes = newer.filter("_before is null or _before < vote_id").withColumn("previous_value", F.lag("value").over(by)).withColumn("last", F.lead("vote_id").over(by).isNull())
        keep(changes.filter("_new").select(*key, "value", "previous_value", "vote_id", "last"), folder, "votes", number)

    return Fold(votes, step, lambda spark, folder: kept(spark, folder, "votes", schema).drop("batch"))


def _folded(fold: Fold, folder: str, state: str) -> DataFrame:
    step = lambda rows, number: fold.step(rows, number, folder)
    fold.rows.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(step).start().awaitTermination()
    return fold.result(fold.rows.sparkSession, folder)


def replay(stream: DataFrame | Fold, checkpoint: str, mode: str = "append") -> DataFrame:
    """What a stream yields over all that is available now, as a table below checkpoint, a folder that all executors reach.

    In complete mode each micro-batch replaces the table under its own number, so a batch that runs again does no harm.
    """
    name = uuid.uuid4().hex
    if isinstance(stream, Fold):
        return _folded(stream, f"{checkpoint}/{name}", f"{checkpoint}/{name}-state")
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{checkpoint}/{name}-state").trigger(availableNow=True)
    out = f"{checkpoint}/{name}"
    if mode != "complete":
        writer.format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    numbers = [-1]

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")
        numbers.append(number)

    writer.foreachBatch(batch).start().awaitTermination()
    if max(numbers) < 0:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{out}/batch={max(numbers)}")


def in_batches(parts: list[DataFrame], build: Callable[[DataFrame], DataFrame | Fold], folder: str, each: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """What the stream that build makes of a folder of files yields as the parts arrive in it one after the other: each part is written there, and the query is
    started again from its checkpoint, so a part is a micro-batch. With each, micro-batches are handed to it with their number instead of being written.

    folder is one that all executors reach. Restarts lose nothing and repeat nothing: the query knows which files it has read.
    """
    spark, schema = parts[0].sparkSession, parts[0].schema
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        stream = build(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        if isinstance(stream, Fold):
            out = _folded(stream, f"{folder}/out", f"{folder}/state")
            continue
        writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        writer = writer.foreachBatch(each) if each else writer.format("parquet").option("path", f"{folder}/out")
        writer.start().awaitTermination()
    if isinstance(stream, Fold):
        return out
    return None if each else spark.read.schema(stream.schema).parquet(f"{folder}/out")


def delivered(parts: list[DataFrame], build: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """Deliveries (session_id, delivery, kind, item_id, author, author_role, ...) of a stream, each written once, whoever receives it.

    Micro-batches are written under their number, so one that runs again replaces itself.
    """

    def keep(df: DataFrame, number: int) -> None:
        df.select("session_id", "delivery", "kind", "item_id", "author", "author_role").write.mode("overwrite").parquet(f"{folder}/sent/batch={number}")

    in_batches(parts, build, folder, keep)
    return parts[0].sparkSession.read.parquet(f"{folder}/sent").drop("batch")


def _active(items: DataFrame, recipients: DataFrame) -> DataFrame:
    """(session_id, delivery, recipient): who is active at a delivery."""
    return items.select("session_id", "delivery").distinct().join(recipients, "session_id").filter("since <= delivery and (until is null or until > delivery)").select("session_id", "delivery", "recipient")


def fan_out(parts: list[DataFrame], build: Callable[[DataFrame], DataFrame], recipients: DataFrame, folder: str) -> DataFrame:
    """Deliveries (session_id, delivery, kind, item_id, author, author_role, ...) of a stream to their session's recipients, as R.deliveries has them, with the delivery's number.

    recipients (session_id, recipient, since, until) says from which delivery on a recipient is active and at which it has left (null: it hasn't). What is
    written is each item once; copies for recipients are made as they are read.
    """
    items = delivered(parts, build, folder)
    rank = F.when(F.col("kind") == "post", 0).when(F.col("kind") == "comment", 1).otherwise(2)
    # a session and delivery is one key, so that a recipient gets what came while it was active
    key = F.struct("session_id", "delivery").alias("session_id")
    sent = deliveries(items.select(key, "kind", rank.alias("type_rank"), "item_id", "author", "author_role"), _active(items, recipients).select(key, "recipient"))
    return sent.select("session_id.session_id", "session_id.delivery", *(c for c in sent.columns if c != "session_id"))


def received(items: DataFrame, recipients: DataFrame) -> DataFrame:
    """(session_id, delivery, recipient, n, n_anonymous, items): what fan_out's rows of delivered items come to for each recipient and delivery; none where nothing comes.

    A recipient gets all of a delivery but its own items, so the delivery's totals less the recipient's own are its totals, and no item is copied for its recipients.
    """
    judged = (F.col("kind") == "vote") & (F.col("author_role") == "judge")
    sums = lambda rows: rows.agg(F.count("*").alias("n"), F.count_if(judged).alias("n_anonymous"), F.sum("item_id").alias("items"))
    own = sums(items.groupBy("session_id", "delivery", F.col("author").alias("recipient")))
    total = sums(items.groupBy("session_id", "delivery"))
    less = [(F.col(f"t.{c}") - F.coalesce(F.col(f"o.{c}"), F.lit(0))).alias(c) for c in ("n", "n_anonymous", "items")]
    rows = _active(items, recipients).join(own.alias("o"), ["session_id", "delivery", "recipient"], "left").join(total.alias("t"), ["session_id", "delivery"])
    return rows.select("session_id", "delivery", "recipient", *less).filter("n > 0")


def _watermarked(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream with its watermark, which takes times with a zone only: those without one are read in the session's, UTC."""
    if not events.isStreaming:
        return events
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def idle_sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 hour", key: str = "user_id", time: str = "ts") -> DataFrame | Fold:
    """Sessions of activity (key, started, ended, n_events): they end when nothing has come for the gap. Batch or stream; a stream has a watermark."""
    if events.isStreaming:
        return _idle_fold(events, gap, late, key, time)
    kind = events.schema[time].dataType
    grouped = events.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n_events"))
    return grouped.select(key, F.col("w.start").cast(kind).alias("started"), F.col("w.end").cast(kind).alias("ended"), "n_events")


def _idle_fold(events: DataFrame, gap: str, late: str, key: str, time: str) -> Fold:
    """A row is late when the watermark before its micro-batch has passed the end of the session that it alone would be. A row in time may still lengthen a session whose end has been
    passed, as its own end lies later: an operator that gives such a session away would cut it in two. So a session is final only when the watermark is a gap beyond its end. Until
    then it stays in state, and those that have ended by the last watermark are read from there, as they are by then.
    """
    micros = lambda t: pd.Timedelta(t).value // 1000
    pause, wait, kind = micros(gap), micros(late), events.schema[time].dataType
    name = events.schema[key].dataType.simpleString()
    schema = f"{key} {name}, started long, last long, n_events long, closed boolean, final boolean"

    def step(rows: DataFrame, number: int, folder: str) -> None:
        spark = rows.sparkSession
        new = rows.select(key, F.unix_micros(F.col(time).cast("timestamp")).alias("started")).filter("started is not null")
        before = kept(spark, folder, "newest", "at long").filter(F.col("batch") < number).agg(F.max("at")).first()[0] if number else None
        newest = max((t for t in (before, new.agg(F.max("started")).first()[0]) if t is not None), default=None)
        passed = lambda t: F.lit(None if t is None else t // 1000 * 1000 - wait).cast("long")  # noqa: E731  # watermarks are whole milliseconds
        new = new.filter(passed(before).isNull() | (F.col("started") + pause > passed(before)))
        spans = new.select(key, "started", F.col("started").alias("last"), F.lit(1).cast("long").alias("n_events"))
        if number:
            spans = spans.union(kept(spark, folder, "sessions", schema).filter((F.col("batch") == number - 1) & ~F.col("final")).select(spans.columns))
        order = Window.partitionBy(key).orderBy("started", "last")
        fresh = F.coalesce(F.col("started") - F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)) >= pause, F.lit(True))
        numbered = spans.withColumn("_fresh", fresh.cast("int")).withColumn("_session", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        joined = numbered.groupBy(key, "_session").agg(F.min("started").alias("started"), F.max("last").alias("last"), F.sum("n_events").alias("n_events"))
        over = lambda more: F.coalesce(F.col("last") + pause + more <= passed(newest), F.lit(False))
        keep(joined.select(key, "started", "last", "n_events", over(0).alias("closed"), over(pause).alias("final")), folder, "sessions", number)
        keep(spark.range(1).select(F.lit(newest).cast("long").alias("at")), folder, "newest", number)

    def result(spark: SparkSession, folder: str) -> DataFrame:
        sessions = kept(spark, folder, "sessions", schema)
        newest = kept(spark, folder, "newest", "at long").agg(F.max("batch")).first()[0]
        at = lambda t: F.timestamp_micros(t).cast(kind)
        return sessions.filter(F.col("final") | (F.col("closed") & (F.col("batch") == newest))).select(key, at(F.col("started")).alias("started"), at(F.col("last") + pause).alias("ended"), "n_events")

    return Fold(events, step, result)


def event_windows(events: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Tumbling or sliding windows: events and their mean value for each type. Batch or stream."""
    kind = events.schema[time].dataType
    window = F.window(time, length, slide) if slide else F.window(time, length)
    grouped = _watermarked(events, time, late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.round(F.avg("value"), 6).alias("mean_value"))
    return grouped.select(F.col("w.start").cast(kind).alias("started"), F.col("w.end").cast(kind).alias("ended"), "event_type", "n_events", "mean_value")


def without_repeats(items: DataFrame, late: str = "1 hour", time: str = "ts", keys: tuple[str, ...] = ("kind", "item_id")) -> DataFrame:
    """Each item once, as long as its repeats come within the watermark."""
    if items.isStreaming:
        return _watermarked(items, time, late).dropDuplicatesWithinWatermark(list(keys))
    return items.dropDuplicates(list(keys))


def drained_rounds(batches: DataFrame, queue: str, round_: str, order: str) -> DataFrame:
    """(queue, round, batches, items) of batches (queue, round, order, items array, nudge, last): all that came for a round as one list. An end marker (last) and what follows it count in no round of the queue; a round of nudges has no items and stays only if there is one."""
    upto = Window.partitionBy(queue).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    live = batches.withColumn("_ended", F.max(F.col("last").cast("int")).over(upto)).filter("_ended = 0")
    kind = batches.schema["items"].dataType
    listed = F.sort_array(F.collect_list(F.struct(order, F.coalesce("items", F.array().cast(kind)).alias("items"))))
    out = live.groupBy(queue, round_).agg(F.count("*").alias("batches"), F.flatten(F.transform(listed, lambda x: x["items"])).alias("items"))
    return out.filter((F.size("items") > 0) | (F.col("batches") == 1))
