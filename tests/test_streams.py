"""Streams with state: what each yields over several micro-batches, restarted between them."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.streaming import forum as ST
from tallyloom.streaming import stateful as X


def parts_of(spark, rows, schema):
    """Rows whose last column is the part that they come in."""
    df = spark.createDataFrame(rows, schema + ", part int")
    return [df.filter(F.col("part") == k).drop("part") for k in range(max(r[-1] for r in rows) + 1)]


def test_ids_stay(spark, tmp_path):
    rows = [(1, "p", 50, 1, 0), (1, "p", 9, 2, 0), (1, "p", 50, 3, 1), (1, "p", 7, 4, 1), (1, "c", 9, 5, 1), (2, "p", 9, 6, 1), (1, "p", 9, 7, 2)]
    out = ST.in_batches(parts_of(spark, rows, "session_id long, kind string, item_id long, seq long"), X.assign_ids, str(tmp_path))
    assert sorted(tuple(r) for r in out.collect()) == [(1, "c", 9, 1), (1, "p", 7, 3), (1, "p", 9, 2), (1, "p", 50, 1), (2, "p", 9, 1)]


@pytest.mark.parametrize(
    "waiting,wanted",
    [
        ("ab", (["a", "b"], None, False, 0)), ("n", (None, "n", False, 0)), ("na", (["a"], None, False, 0)), ("nn", (None, None, True, 0)), ("E", (None, None, True, 0)), ("aEb", (["a"], None, False, 2)), ("nE", (None, None, True, 0)),
    ],
)
def test_draining(waiting, wanted):
    items, nudge, ended, rest = X.drain([(None, None, True) if w == "E" else (None, w, False) if w == "n" else ([w], None, False) for w in waiting])
    assert (items, nudge, ended, len(rest)) == wanted


def test_queues(spark, tmp_path):
    q = lambda seq, action, part, items=None, nudge=None: ("q", seq, action, items, nudge, part)
    rows = [q(1, "items", 0, ["a"]), q(2, "items", 0, ["b"]), q(3, "nudge", 0, None, "n"), q(4, "ready", 1), q(5, "ready", 1), q(6, "nudge", 1, None, "hey"), q(7, "items", 1, ["c"]), q(8, "end", 1), q(9, "items", 1, ["d"]), q(10, "ready", 2), q(11, "ready", 2), q(12, "ready", 2)]
    out = ST.in_batches(parts_of(spark, rows, "queue string, seq long, action string, items array<string>, nudge string"), X.drained_rounds, str(tmp_path))
    assert [(r["round"], r["items"], r["nudge"], r["ended"]) for r in out.orderBy("round").collect()] == [(0, ["a", "b"], None, False), (1, None, "hey", False), (2, ["c"], None, False), (3, None, None, True)]


def test_deliveries_and_fan_out(spark, tmp_path):
    schema = "session_id long, kind string, item_id long, author string, author_role string, content string, target_type string, target_id long, value long"
    vote = lambda k, who, role, value, part: (1, "vote", k, who, role, None, "post", 5, value, part)
    said = lambda kind, k, part: (1, kind, k, "w", "actor", "hi", None, None, None, part)
    rows = [vote(1, "u", "judge", 2, 0), vote(2, "v", "actor", 1, 0), said("post", 7, 1), vote(3, "u", "judge", -1, 1), vote(4, "v", "actor", -1, 2), said("comment", 9, 3), said("post", 8, 3)]
    parts = parts_of(spark, rows, schema)
    got = [tuple(r) for r in ST.in_batches(parts, X.deliveries, str(tmp_path / "a")).orderBy("delivery", "place").select("delivery", "kind", "item_id", "value", "previous_value", "target_score").collect()]
    assert got == [(0, "post", 7, None, None, None), (0, "vote", 1, 2, None, 0), (0, "vote", 2, 1, None, 0), (0, "vote", 3, -1, 2, 0), (1, "post", 8, None, None, None), (1, "comment", 9, None, None, None), (1, "vote", 4, -1, 1, -2)]
    blind = ST.in_batches(parts, lambda s: X.deliveries(s, judges_visible=False), str(tmp_path / "b")).filter("kind = 'vote'")
    assert {r.item_id: r.target_score for r in blind.collect()} == {1: 1, 2: 1, 3: 1, 4: -1}
    people = spark.createDataFrame([(1, "u", 0, None), (1, "w", 0, None), (1, "late", 1, None), (1, "gone", 0, 1)], "session_id long, recipient string, since int, until int")
    sent = ST.fan_out(parts, X.deliveries, people, str(tmp_path / "c")).collect()
    assert sorted((r.delivery, r.recipient, r.item_id) for r in sent if r.recipient in ("late", "gone", "w")) == [
        (0, "gone", 1), (0, "gone", 2), (0, "gone", 3), (0, "gone", 7), (0, "w", 1), (0, "w", 2), (0, "w", 3), (1, "late", 4), (1, "late", 8), (1, "late", 9), (1, "w", 4)
    ]
    assert {r.author for r in sent if r.recipient == "w" and r.item_id in (1, 3)} == {"Anonymous Scientist"}


def test_fan_out_writes_each_item_once(spark, tmp_path):
    """300 people of one session: 90,000 copies are counted, and 300 rows are written."""
    rows = [(1, "vote" if k % 3 else "post", k, f"u{k}", "judge" if k % 5 == 0 else "actor", "x", "post" if k % 3 else None, 0 if k % 3 else None, 1 if k % 3 else None, 0) for k in range(300)]
    parts = parts_of(spark, rows, "session_id long, kind string, item_id long, author string, author_role string, content string, target_type string, target_id long, value long")
    people = spark.createDataFrame([(1, f"u{k}", k % 2, None if k % 7 else 1) for k in range(302)], "session_id long, recipient string, since int, until int")
    sent = ST.fan_out(parts, X.deliveries, people, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "sent")).count() == 300
    wanted = sent.groupBy("session_id", "delivery", "recipient").agg(F.count("*").alias("n"), F.count_if(F.col("author") == "Anonymous Scientist").alias("n_anonymous"), F.sum("item_id").alias("items"))
    got = ST.received(spark.read.parquet(str(tmp_path / "sent")), people)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect())) and got.count() == 151


def test_idle_rounds(spark, tmp_path):
    at = lambda h, m=0, s=0: dt.datetime(2024, 1, 1, h, m, s, tzinfo=dt.timezone.utc)
    rows = [
        (1, at(0), True, None, 0), (1, at(0, 1, 30), True, None, 0), (2, at(0), True, at(0, 2, 30), 0), (4, at(0), True, at(9), 0), (5, at(0), False, None, 0),
        (3, at(5), True, None, 1), (1, at(4, 30), True, None, 1), (6, at(4, 45), True, None, 1), (6, at(0), True, None, 2), (3, at(9), False, None, 2),
    ]
    out = ST.in_batches(parts_of(spark, rows, "session_id long, ts timestamp, content boolean, busy_until timestamp"), X.idle_rounds, str(tmp_path))
    got = sorted((r.session_id, r.action, pd.Timestamp(r.acted_at).strftime("%H:%M:%S")) for r in out.withColumn("acted_at", F.date_format("acted_at", "2024-01-01 HH:mm:ss")).collect())
    assert got == [
        (1, "end", "00:03:30"), (1, "nudge", "00:01:00"), (1, "nudge", "00:02:30"), (2, "end", "00:02:30"), (2, "nudge", "00:01:00"), (3, "end", "05:02:00"), (3, "nudge", "05:01:00"),
        (4, "end", "00:04:00"), (4, "nudge", "00:01:00"), (6, "end", "04:47:00"), (6, "nudge", "04:46:00"),
    ], "the row behind the watermark is dropped, and what comes after an end counts no more"


def test_a_row_in_time_lengthens_a_session_that_the_watermark_has_passed(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    # the first part's watermark is 10:00: what starts by 09:00 is late in the second, and 09:10 is in time, though the session of 08:50 has ended at 09:50
    rows = [(1, at(8, 50), 0), (2, at(11), 0), (1, at(9, 10), 1), (3, at(9), 1), (4, at(9, 1), 1), (5, at(5), 0), (2, at(14), 1)]
    out = ST.in_batches(parts_of(spark, rows, "user_id long, ts timestamp_ntz"), ST.idle_sessions, str(tmp_path))
    assert sorted(tuple(r) for r in out.collect()) == [(1, at(8, 50), at(10, 10), 2), (2, at(11), at(12), 1), (4, at(9, 1), at(10, 1), 1), (5, at(5), at(6), 1)]


def test_votes_fold_without_python_for_each_key(spark, tmp_path):
    """Each vote follows the one before over micro-batches, whatever order and repeats they come in, and no Python runs for a key."""
    rows = [(k % 5, "post", k % 3, k % 7 - 3, k, k % 4 // 2 if k < 60 else 2) for k in range(90)] + [(1, "post", 1, 9, 31, 2), (2, "comment", 1, 1, 4, 1), (2, "comment", 1, 1, 4, 1)]
    parts = parts_of(spark, rows, "voter long, target_type string, target_id long, value int, vote_id long")
    state, wanted = {}, []
    for part in range(3):
        for *key, value, number, _ in sorted((r for r in rows if r[-1] == part), key=lambda r: r[4]):
            before, last = state.get(tuple(key), (None, -1))
            if number > last:
                wanted.append((*key, value, before, number))
                state[tuple(key)] = (value, number)
    seen = []
    out = ST.in_batches(parts, lambda s: seen.append(ST.fold_votes(s)) or seen[-1], str(tmp_path))
    assert sorted(map(tuple, out.collect()), key=lambda r: (r[5], r)) == sorted(wanted, key=lambda r: (r[5], r))
    assert all(isinstance(x, ST.Fold) for x in seen)


def test_ids_of_one_large_session(spark, tmp_path):
    """A session with most items is numbered over ranges of them, and goes on where it was; keys may be null."""
    rows = [(1, "p", (k * 7919) % 2000, k, k // 2000) for k in range(4000)] + [(1, "p", 5000 + k, 3999 - k, 1) for k in range(500)] + [(None, "p", 3, 1, 0), (None, "p", 3, 2, 1), (None, "p", 4, 3, 1)]
    seen = []
    out = ST.in_batches(parts_of(spark, rows, "session_id long, kind string, item_id long, seq long"), lambda s: seen.append(X.assign_ids(s)) or seen[-1], str(tmp_path))
    got = {(r.session_id, r.item_id): r.local_id for r in out.collect()}
    wanted = {(1, (k * 7919) % 2000): k + 1 for k in range(2000)} | {(1, 5499 - k): 2001 + k for k in range(500)} | {(None, 3): 1, (None, 4): 2}
    assert got == wanted and out.count() == len(wanted) and all(isinstance(x, ST.Fold) for x in seen)


def test_queues_of_all_kinds_against_the_plain_rule(spark, tmp_path):
    """Random queues over three micro-batches against a loop over their rows."""
    rng = random.Random(5)
    rows, wanted = [], []
    for q in range(600):
        ready, ended, number, waiting = False, False, 0, []
        share = rng.choice([(5, 5, 2, 0), (3, 6, 1, 1), (6, 2, 1, 1), (1, 5, 5, 0), (5, 5, 1, 1)])
        for k in range(rng.randint(1, 14)):
            action = rng.choices(["ready", "items", "nudge", "end"], share)[0]
            items = [f"{k}{c}" for c in "ab"[: rng.choice([1, 1, 2, 0])]] if action == "items" else None
            rows.append((q, k, action, items, f"n{k}" if action == "nudge" else None, k * 3 // 14 if q % 3 else 0))
            if ended:
                continue
            if action == "ready":
                ready = True
            else:
                waiting.append((items, rows[-1][4], action == "end"))
            if ready and waiting:
                items, nudge, ended, waiting = X.drain(waiting)
                wanted.append((q, number, items, nudge, ended))
                number, ready = number + 1, False
    seen = []
    parts = parts_of(spark, rows, "queue long, seq long, action string, items array<string>, nudge string")
    out = ST.in_batches(parts, lambda s: seen.append(X.drained_rounds(s)) or seen[-1], str(tmp_path))
    assert sorted(tuple(r) for r in out.collect()) == sorted(wanted) and len(wanted) > 700
    assert all(isinstance(x, ST.Fold) for x in seen)


def test_idle_rounds_of_all_kinds_against_the_plain_rule(spark, tmp_path):
    """Random sessions over four micro-batches against a loop over their rows, without Python for each session."""
    idle, grace, late = 60_000, 120_000, 300_000
    rng, start = random.Random(8), dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = []
    for session in [None, *range(500)]:
        for _ in range(rng.randint(1, 12)):
            second = rng.choice([rng.randint(0, 1800), 30 * rng.randint(0, 60)])
            part = min(3, max(0, second // 450 + rng.choice([0] * 8 + [1, 2])))
            busy = None if rng.random() < 0.6 else start + dt.timedelta(seconds=second + rng.choice([5, 100, 150, 900]))
            rows.append((session, start + dt.timedelta(seconds=second, microseconds=rng.choice([0, 0, 400, 1000])), rng.choice([True, True, False, None]), busy, part))
    # the first part's watermark is 100 s: a row of the second that lies within its millisecond is late, one of the next isn't
    rows = [r for r in rows if r[-1] or r[1] <= start + dt.timedelta(seconds=400)] + [(600, start + dt.timedelta(seconds=400), False, None, 0), (8, None, True, None, 0)]
    rows += [(601, start + dt.timedelta(seconds=100, microseconds=900), True, None, 1), (602, start + dt.timedelta(seconds=100, microseconds=1000), True, None, 1)]
    millis = lambda t: None if t is None else (t - start) // dt.timedelta(milliseconds=1)
    passed, sessions, dropped = None, {}, 0
    for part in range(4):
        new = [(s, millis(t), bool(content), millis(busy)) for s, t, content, busy, p in rows if p == part and t is not None]
        for session, at, content, busy in new:
            if passed is None or at > passed:
                sessions.setdefault(session, []).append((at, content, busy))
            else:
                dropped += 1
        passed = max([passed] * (passed is not None) + [r[1] - late for r in new])
    wanted = []
    for session, some in sessions.items():
        due, nudged, until = None, False, 0
        for at, content, busy in [*sorted((r for r in some if r[0] <= passed), key=lambda r: r[0]), (passed + 1, False, None)]:
            if due is not None and not nudged and due < at:
                wanted.append((session, due, "nudge"))
                due, nudged = due + idle, True
            end = min(max(due, until), due + grace) if nudged else None
            if nudged and end < at:
                wanted.append((session, end, "end"))
                break
            until = max(until, busy or 0)
            if content:
                due, nudged = at + idle, False
    seen = []
    parts = parts_of(spark, rows, "session_id long, ts timestamp, content boolean, busy_until timestamp")
    out = ST.in_batches(parts, lambda s: seen.append(X.idle_rounds(s, 60, 120, "5 minutes")) or seen[-1], str(tmp_path))
    origin = int(start.timestamp() * 1000)
    got = [(r.session_id, r.at - origin, r.action) for r in out.select("session_id", F.unix_millis("acted_at").alias("at"), "action").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(wanted, key=key)
    assert len(wanted) > 800 and dropped > 30 and {r[0] for r in wanted} & {601, 602} == {602} and sum(r[2] == "end" for r in wanted) > 300
    assert all(isinstance(x, ST.Fold) for x in seen)
