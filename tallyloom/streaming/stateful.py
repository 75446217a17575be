"""Streams with state of their own for each key: ids, queues and idle rounds by joins and windows over what earlier micro-batches have left in tables, deliveries
by transformWithState on RocksDB.

State is written entry by entry, so what a micro-batch writes follows its own rows and not a key's history. Rows of a key are taken in the order of
their number (or time), whatever micro-batch or task order they come in.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.running import running_sums
from ..sources.scratch import written
from .forum import Fold, keep, kept

# processors travel with their code: the process that Spark starts for them beside the driver doesn't know the shipped package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """State of several variables lives in RocksDB only; a provider that is set stays."""
    if spark.conf.get(_PROVIDER, None) in (None, "", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
        spark.conf.set(_PROVIDER, _ROCKS)


def _in_order(frames: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(list(by), kind="stable")


# ---- ids in the order of first sight


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """left with the other columns of right, where keys are equal or both null."""
    right = right.select(*(F.col(k).alias(f"_r_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    joined = left.join(right, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], how)
    return joined if how in ("left_anti", "left_semi") else joined.drop(*(f"_r_{k}" for k in keys))


def assign_ids(items: DataFrame) -> Fold:
    """A stream of (session_id, kind, item_id, seq) with local_id: the number, from 1 for each session and kind, in the order in which items are first
    seen. Repeated items keep theirs and give no row. State is what has been given out; new items are numbered over ranges, so no task holds a session's."""
    group, types = ["session_id", "kind"], {f.name: f.dataType.simpleString() for f in items.schema}
    schema = f"session_id {types['session_id']}, kind {types['kind']}, item_id long, local_id long"

    def step(rows: DataFrame, number: int, folder: str) -> None:
        new = rows.groupBy(*group, F.col("item_id").cast("long").alias("item_id")).agg(F.min("seq").alias("seq"))
        known = kept(rows.sparkSession, folder, "ids", schema).filter(F.col("batch") < number) if number else None
        if known is not None:
            new = _joined(new, known.select(*group, "item_id"), [*group, "item_id"], "left_anti")
        places = running_sums(written(new.withColumn("_one", F.lit(1).cast("long")), "new-items"), group, ["seq", "item_id"], "_one", "_place")
        last = F.lit(0)
        if known is not None:  # a row for each session and kind
            places, last = _joined(places, known.groupBy(*group).agg(F.max("local_id").alias("_last")), group, "left"), F.coalesce("_last", F.lit(0))
        keep(places.select(*group, "item_id", (F.col("_place") + last).cast("long").alias("local_id")), folder, "ids", number)

    return Fold(items, step, lambda spark, folder: kept(spark, folder, "ids", schema).drop("batch"))


# ---- queues


def drain(waiting: list[tuple]) -> tuple[list | None, str | None, bool, list[tuple]]:
    """(items, nudge, ended, what stays) of the batches (items, nudge, end marker) that wait, in order, of which there is one at least: one round takes all
    batches up to an end marker, which stays for the round after. A nudge is the input only if nothing else waits. A marker that comes first
    ends the queue, and so does a round that is left without items."""
    first, rest = waiting[0], waiting[1:]
    if first[2]:
        return None, None, True, []
    if first[1] is not None and not rest:
        return None, first[1], False, []
    stop = next((k for k, w in enumerate(rest) if w[2]), len(rest))
    items = [x for w in (first, *rest[:stop]) if w[0] for x in w[0]]
    return items or None, None, not items, rest[stop:] if items else []


def drained_rounds(batches: DataFrame) -> Fold:
    """(queue, round, items, nudge, ended) of a stream (queue, seq, action, items array<string>, nudge) of what happens to queues: action is items, nudge, end,
    or ready when the queue's participant waits for input. A participant that is ready takes at once whatever comes first (see drain).

    State is what waits, written once as it comes, and a queue's mode (next round, ready, ended, and the place up to which all is taken) for each micro-batch that brings it rows.
    """
    types = {f.name: f.dataType.simpleString() for f in batches.schema}
    rounds = f"queue {types['queue']}, round long, items array<string>, nudge string, ended boolean"
    waiting = f"queue {types['queue']}, seq {types['seq']}, stop boolean, items array<string>, nudge string"
    modes = f"queue {types['queue']}, next long, ready boolean, ended boolean, upto struct<batch:int,seq:{types['seq']}>"

    def step(rows: DataFrame, number: int, folder: str) -> None:
        spark, does = rows.sparkSession, lambda c: F.coalesce(F.col("action") == c, F.lit(False))
        new = rows.select("queue", F.lit(number).alias("batch"), "seq", does("ready").alias("ready"), does("end").alias("stop"), F.when(does("items"), F.col("items")).alias("items"), F.when(does("nudge"), F.col("nudge")).alias("nudge"))
        every = new.withColumn("mode", F.lit(None).cast(f"struct<next:bigint,ready:boolean,ended:boolean,upto:struct<batch:int,seq:{types['seq']}>>"))
        if number:
            mode = kept(spark, folder, "modes", modes).filter(F.col("batch") < number).groupBy("queue").agg(F.max_by(F.struct("next", "ready", "ended", "upto"), "batch").alias("mode"))
            held = _joined(kept(spark, folder, "waiting", waiting).filter(F.col("batch") < number), mode, ["queue"], "inner")
            held = held.filter(~F.col("mode.ended") & (F.col("mode.upto").isNull() | (F.struct("batch", "seq") > F.col("mode.upto")))).withColumn("ready", F.lit(False))
            # a queue's mode comes before all rows, and counts as one of them if its participant is ready
            marks = mode.select("queue", F.lit(-1).alias("batch"), F.lit(None).cast(types["seq"]).alias("seq"), F.col("mode.ready").alias("ready"), F.lit(False).alias("stop"), F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("string").alias("nudge"), "mode")
            every = every.unionByName(held).unionByName(marks)
        groups = written(_taken(every, number), "queues")
        keep(_rounds(groups), folder, "rounds", number)
        tail = (F.col("g") == F.col("closings")) & ~F.col("stopped") & (F.col("n") == 0) & (F.col("n_ready") > 0)
        after = groups.groupBy("queue").agg(
            (F.max("next") + F.sum(F.size("outs"))).alias("next"), F.coalesce(F.bool_or(tail), F.lit(False)).alias("ready"), F.bool_or(F.exists("outs", lambda x: x["ended"])).alias("ended"),
            F.coalesce(F.max(F.when((F.col("g") < F.col("closings")) | ((F.col("n") > 0) & (F.size("outs") > 0)), F.col("last"))), F.max("upto")).alias("upto"),
        )
        keep(after, folder, "modes", number)
        left = _joined(new.filter("not ready"), kept(spark, folder, "modes", modes).filter(F.col("batch") == number).select("queue", "ended", "upto"), ["queue"], "inner")
        left = left.filter(~F.col("ended") & (F.col("upto").isNull() | (F.struct("batch", "seq") > F.col("upto"))))
        keep(left.select("queue", "seq", "stop", "items", "nudge"), folder, "waiting", number)

    return Fold(batches, step, lambda spark, folder: kept(spark, folder, "rounds", rounds).drop("batch"))


def _taken(every: DataFrame, number: int) -> DataFrame:
    """What lies between a queue's rounds (g), with the rounds that come of it (outs), for queues that are not over and have rows in this micro-batch.

    Up to the first end marker, a round is closed by the first row of a run of like rows (ready or not), as it meets the run before: the ready one takes what waits, or what comes is
    taken by the one that is ready. It isn't, if the round before has used the whole run before up, which has one row then. So behind a longer run the first row closes a round, and
    behind runs of one row each second one does. Behind the marker only the next two ready ones count.
    """
    whole = Window.partitionBy("queue")
    o = whole.orderBy("batch", "seq")
    upto, before = o.rowsBetween(Window.unboundedPreceding, 0), o.rowsBetween(Window.unboundedPreceding, -1)
    count = lambda c: F.sum(c.cast("int"))
    rows = every.withColumn("mode", F.first("mode", ignorenulls=True).over(whole)).withColumn("_live", F.max("batch").over(whole) == number)
    rows = rows.filter(F.col("_live") & ~F.coalesce("mode.ended", F.lit(False)) & ((F.col("batch") >= 0) | F.col("ready")))
    rows = rows.withColumn("_stops", count(F.col("stop")).over(upto)).withColumn("plain", F.col("_stops") == 0)
    rows = rows.filter(F.col("plain") | F.col("ready") | (F.col("stop") & (F.col("_stops") == 1)))
    rows = rows.withColumn("_one", F.lag("ready", 1).over(o)).withColumn("_two", F.lag("ready", 2).over(o))
    start = F.col("plain") & (F.col("_one").isNull() | (F.col("_one") != F.col("ready")))
    rows = rows.withColumn("_start", start).withColumn("_run", count(F.col("_start")).over(upto))
    longer = F.col("_start") & F.coalesce(F.col("_one") == F.col("_two"), F.lit(False))
    rows = rows.withColumn("_since", F.coalesce(F.max(F.when(longer, F.col("_run"))).over(upto), F.lit(0)))
    rows = rows.withColumn("_closes", F.col("_start") & ((F.col("_run") - F.col("_since")) % 2 == 0))
    rows = rows.withColumn("g", F.coalesce(count(F.col("_closes")).over(before), F.lit(0))).withColumn("closings", count(F.col("_closes")).over(whole))
    rows = rows.withColumn("stopped", F.max("stop").over(whole)).withColumn("_asked", count(F.col("ready") & ~F.col("plain")).over(whole))
    comes = F.col("plain") & ~F.col("ready")
    taken = comes & F.col("items").isNotNull() & ((F.col("g") < F.col("closings")) | (F.col("_asked") > 0))  # what goes on waiting isn't gathered
    groups = rows.groupBy("queue", "g", "closings", "stopped", "_asked").agg(
        F.coalesce(F.max("mode.next"), F.lit(0)).alias("next"), F.max("mode.upto").alias("upto"), F.count_if(comes).alias("n"), F.count_if(F.col("plain") & F.col("ready")).alias("n_ready"),
        F.max(F.when(comes, F.col("nudge"))).alias("nudge"), F.max(F.when(F.col("plain") & (F.col("batch") >= 0), F.struct("batch", "seq"))).alias("last"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.when(taken, F.struct("batch", "seq", "items")))), lambda x: x["items"])).alias("items"),
    )
    some, single = F.size("items") > 0, (F.col("n") == 1) & F.col("nudge").isNotNull()
    out = lambda items, nudge, ended: F.struct(items.cast("array<string>").alias("items"), nudge.cast("string").alias("nudge"), ended.alias("ended"))
    none, over = F.lit(None), F.lit(True)
    end, given = out(none, none, over), out(F.col("items"), none, F.lit(False))
    closed = out(F.when(some, F.col("items")), F.when(single, F.col("nudge")), ~some & ~single)
    last = F.when((F.col("n") == 0) & ((F.col("n_ready") > 0) | (F.col("_asked") > 0)), F.array(end)).when((F.col("n") > 0) & (F.col("_asked") > 0), F.when(~some, F.array(end)).when(F.col("_asked") > 1, F.array(given, end)).otherwise(F.array(given)))
    outs = F.when(F.col("g") < F.col("closings"), F.array(closed)).when(F.col("stopped"), last)
    return groups.withColumn("outs", F.coalesce(outs, F.array().cast("array<struct<items:array<string>,nudge:string,ended:boolean>>"))).drop("items", "nudge", "_asked")


def _rounds(groups: DataFrame) -> DataFrame:
    """The rounds up to the one that ends their queue."""
    each = groups.select("queue", "next", "g", F.posexplode("outs").alias("k", "out"))
    over = F.max("out.ended").over(Window.partitionBy("queue").orderBy("g", "k").rowsBetween(Window.unboundedPreceding, -1))
    open_ = each.withColumn("_over", F.coalesce(over, F.lit(False))).filter("not _over")
    return open_.select("queue", (F.col("next") + F.col("g") + F.col("k")).cast("long").alias("round"), "out.items", "out.nudge", "out.ended")


# ---- deliveries


_DELIVERY = "session_id {}, delivery long, place long, kind string, item_id long, author string, author_role string, content string, target_type string, target_id long, value long, previous_value long, target_score long"
_RANK = {"post": 0, "comment": 1, "vote": 2}


class _Delivery(StatefulProcessor):
    """Votes change the scores at once and wait; a post or comment takes them along."""

    def __init__(self, judges_visible: bool):
        self._visible = judges_visible

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._cast = handle.getMapState("cast", "author string, target_type string, target_id long", "value long")
        self._scores = handle.getMapState("scores", "target_type string, target_id long", "score long")
        self._waiting = handle.getListState("waiting", "item_id long, author string, author_role string, target_type string, target_id long, value long, previous_value long")
        self._next = handle.getValueState("next", "n long")

    def handleInputRows(self, key, rows, timerValues):
        new = _in_order(rows, "item_id")
        votes, news = new[new["kind"] == "vote"], new[new["kind"] != "vote"]
        scores: dict[tuple, int] = {}
        cast: dict[tuple, int | None] = {}
        fresh = []
        for r in votes.itertuples():
            target = (r.target_type, int(r.target_id))
            by = (r.author, *target)
            if by not in cast:
                cast[by] = self._cast.getValue(by)[0] if self._cast.containsKey(by) else None
            previous = cast[by]
            fresh.append((int(r.item_id), r.author, r.author_role, *target, int(r.value), previous))
            cast[by] = int(r.value)
            if self._visible or r.author_role != "judge":
                scores[target] = self._score(target, scores) + int(r.value) - (previous or 0)
        for by in cast:
            self._cast.updateValue(by, (cast[by],))
        for target, score in scores.items():
            self._scores.updateValue(target, (score,))
        if not len(news):
            if fresh:
                self._waiting.appendList(fresh)
            return
        number = self._next.get()[0] if self._next.exists() else 0
        self._next.update((number + 1,))
        out = [(_RANK[r.kind], int(r.item_id), r.kind, r.author, r.author_role, r.content, None, None, None, None, None) for r in news.itertuples()]
        for item, author, role, kind, target, value, previous in [*(tuple(x) for x in self._waiting.get()), *fresh]:
            out.append((2, int(item), "vote", author, role, None, kind, int(target), int(value), previous, self._score((kind, int(target)), scores)))
        self._waiting.clear()
        out.sort(key=lambda x: x[:2])
        made = pd.DataFrame([(*key, number, place, k, item, *rest) for place, (_, item, k, *rest) in enumerate(out)], columns=[c.split()[0] for c in _DELIVERY.split(", ")])
        yield made.astype({c: "Int64" for c in ("target_id", "value", "previous_value", "target_score")})

    def _score(self, target: tuple, known: dict) -> int:
        if target not in known:
            known[target] = self._scores.getValue(target)[0] if self._scores.containsKey(target) else 0
        return known[target]

    def close(self) -> None:
        pass


def deliveries(items: DataFrame, judges_visible: bool = True) -> DataFrame:
    """A stream of posts, comments and votes (session_id, kind, item_id, author, author_role, content, target_type, target_id, value) as deliveries: what a session's micro-batch
    brings with at least one post or comment, numbered from 0, in order of kind and id (place).

    Votes alone make no delivery: they wait, and ride along with the next one. A vote's target_score is the target's total over all votes cast by then (without
    judges' unless they are visible), a re-vote replacing the vote before. State has one entry for each voter and target, one for each target, and the votes that
    wait; a micro-batch writes the entries that it changes.
    """
    keyed_state(items.sparkSession)
    kind = items.schema["session_id"].dataType.simpleString()
    wanted = ["session_id", "kind", "item_id", "author", "author_role", "content", "target_type", "target_id", "value"]
    longs = ("item_id", "target_id", "value")
    rows = items.select(*(F.col(c).cast("long").alias(c) if c in longs else F.col(c) for c in wanted))
    return rows.groupBy("session_id").transformWithStateInPandas(_Delivery(judges_visible), _DELIVERY.format(kind), "Append", "None")


# ---- idle rounds


def idle_rounds(activity: DataFrame, idle_seconds: int = 60, grace_seconds: int = 120, late: str = "1 hour") -> Fold:
    """(session_id, acted_at, action) of a stream (session_id, ts timestamp, content boolean, busy_until timestamp): what a session without new content comes to.

    After an idle round its participants are nudged; after a second one the session ends, unless judges are busy then (busy_until), who are
    waited for until they have finished, but for the grace at most. New content before the end begins anew; what comes after the end counts no more.
    Rows later than the watermark are dropped. Times are those of events, in milliseconds: a round passes when the watermark has passed it.

    Rows wait until the watermark has passed them, so that lateness and the cut into micro-batches change nothing. Behind each row, the last content and the longest busy time
    up to it say when the session is nudged and when it ends, if no row comes before. State is what waits, one row for each session that is open, and which ones have ended.
    """
    idle, grace, wait = idle_seconds * 1000, grace_seconds * 1000, pd.Timedelta(late).value // 1_000_000
    kind = activity.schema["session_id"].dataType.simpleString()
    waiting = f"session_id {kind}, at long, content long, busy long"
    rounds = f"session_id {kind}, nudge long, finish long, content long, busy long, open boolean"

    def step(rows: DataFrame, number: int, folder: str) -> None:
        spark, millis = rows.sparkSession, F.unix_millis(F.col("ts"))
        new = rows.select("session_id", millis.alias("at"), F.when(F.col("content"), millis).alias("content"), F.unix_millis(F.col("busy_until")).alias("busy")).filter("at is not null")
        before = kept(spark, folder, "newest", "at long").filter(F.col("batch") < number).agg(F.max("at")).first()[0] if number else None
        newest = max((t for t in (before, new.agg(F.max("at")).first()[0]) if t is not None), default=None)
        early, passed = (F.lit(None if t is None else t - wait).cast("long") for t in (before, newest))  # the watermarks before and after this micro-batch
        new = new.filter(early.isNull() | (F.col("at") > early))
        if number:
            done = kept(spark, folder, "rounds", rounds)
            new = new.union(kept(spark, folder, "waiting", waiting).filter(F.col("batch") == number - 1).select(new.columns))
            new = _joined(new, done.filter((F.col("batch") < number) & F.col("finish").isNotNull()).select("session_id"), ["session_id"], "left_anti")
            # an open session comes as a row of its own before all others
            new = new.union(done.filter((F.col("batch") == number - 1) & F.col("open")).select("session_id", early.alias("at"), "content", "busy"))
        keep(new.filter(F.col("at") > passed), folder, "waiting", number)
        order = Window.partitionBy("session_id").orderBy("at")
        upto, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
        each = new.filter(F.col("at") <= passed).select("session_id", "at", F.max("content").over(upto).alias("content"), F.max("busy").over(upto).alias("busy"), F.lead("at").over(order).alias("next"))
        # of rows of the same time only the last one has anything behind it
        comes = lambda t: F.when((t <= passed) & (F.col("next").isNull() | (t < F.col("next"))), t)
        first, second = F.col("content") + idle, F.col("content") + 2 * idle
        finish = F.when(second.isNotNull(), F.least(F.greatest(second, "busy"), second + grace))
        each = each.withColumn("nudge", F.when((first >= F.col("at")) & (early.isNull() | (first > early)), comes(first))).withColumn("finish", comes(finish))
        each = each.withColumn("_ended", F.max("finish").over(earlier)).filter("_ended is null")
        # without content, a busy time that has passed can't matter any more
        open_ = F.col("next").isNull() & F.col("finish").isNull() & F.coalesce(F.col("content").isNotNull() | (F.col("busy") > passed), F.lit(False))
        each = each.select("session_id", "nudge", "finish", "content", "busy", open_.alias("open"))
        keep(each.filter("open or nudge is not null or finish is not null"), folder, "rounds", number)
        keep(spark.range(1).select(F.lit(newest).cast("long").alias("at")), folder, "newest", number)

    def result(spark: SparkSession, folder: str) -> DataFrame:
        did = lambda c, action: F.struct(F.timestamp_millis(c).alias("acted_at"), F.lit(action).alias("action"))
        return kept(spark, folder, "rounds", rounds).select("session_id", F.inline(F.array(did("nudge", "nudge"), did("finish", "end")))).filter("acted_at is not null")

    return Fold(activity, step, result)
