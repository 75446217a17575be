"""Operators that hold no group as a whole: running sums, draws, quantiles, upserts, masks and timelines."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.operators import rewards as W
from tallyloom.operators import sampling as S
from tallyloom.operators import tokens as K
from tallyloom.operators import trajectory as J
from tallyloom.operators import votes as V
from tallyloom.operators.running import numbered, running_sums
from tallyloom.sources import merge


@pytest.mark.parametrize("parts", [1, 7])
def test_running_sums(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), k, rng.randint(-5, 5), f"x{k}") for k in range(4000)]
    df = spark.createDataFrame(rows, "g string, k int, v int, wide string").repartition(parts)
    got = {r.k: r.s for r in running_sums(df, ["g"], ["k"], "v", "s").collect()}
    total, wanted = Counter(), {}
    for g, k, v, _ in rows:
        total[g] += v
        wanted[k] = total[g]
    assert got == wanted
    assert running_sums(df.limit(0), ["g"], ["k"], "v", "s").count() == 0
    placed = numbered(df, [F.col("v").desc(), F.col("k")]).collect()
    assert [r.k for r in sorted(placed, key=lambda r: r.place)] == [r[1] for r in sorted(rows, key=lambda r: (-r[2], r[1]))]
    assert sorted(r.place for r in placed) == list(range(4000))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 12, 64, 101])
def test_permutations(spark, n):
    df = spark.range(3).crossJoin(spark.range(n).withColumnRenamed("id", "k"))
    got = df.select("id", "k", S.permuted(F.col("k"), n, F.concat(F.lit("s"), F.col("id").cast("string"))).alias("v")).collect()
    by = {i: [r.v for r in sorted(got, key=lambda r: r.k) if r.id == i] for i in range(3)}
    assert all(sorted(v) == list(range(n)) for v in by.values())
    assert n < 12 or len({tuple(v) for v in by.values()}) == 3


def test_draws_are_spread(spark):
    """Each name is about as often any session's first pick."""
    pool = spark.createDataFrame([(f"n{k:02}",) for k in range(20)], "alias string")
    sessions = spark.range(2000).select(F.col("id").alias("session_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("title"))
    cast = S.cast_names(sessions, pool, "title", actors=3, judges=2)
    assert cast.count() == 10_000 and cast.groupBy("session_id").agg(F.countDistinct("alias").alias("n")).filter("n < 5").count() == 0
    first = Counter(r.alias for r in cast.filter("name = 'Scientist_1'").collect())
    assert len(first) == 20 and max(first.values()) < 170 and min(first.values()) > 50
    assert S.cast_names(sessions, pool.limit(2), "title").count() == 4000 and S.cast_names(sessions, pool.limit(0), "title").count() == 0


def test_quantiles_by_group(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 5 + ["cold", None]), rng.choice([rng.randint(0, 50) / 4, None])) for _ in range(5000)] + [("none", None), ("one", 7.0)]
    got = {r.g: (r.q0, r.q1) for r in W.group_quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", [0.1, 0.9]).collect()}
    for g in {g for g, _ in rows} - {"none"}:
        xs = sorted(x for h, x in rows if h == g and x is not None)
        assert got[g] == (xs[int(0.1 * (len(xs) - 1))], xs[int(0.9 * (len(xs) - 1))])
    assert "none" not in got


def test_upserts(spark, tmp_path):
    path = tmp_path / "votes"
    rng = random.Random(9)
    rows = [(rng.randint(1, 9), "post", rng.choice([0] * 5 + list(range(40))), rng.choice([-1, 1, 2]), k) for k in range(600)]
    frame = lambda some: spark.createDataFrame(some, "voter long, target_type string, target_id long, value int, vote_id long")
    state, wanted = {}, {}
    for voter, kind, target, value, k in rows:
        before = state.get((voter, target))
        state[voter, target] = value
        wanted[k] = (before, sum(v for (_, t), v in state.items() if t == target))
    first = merge.upsert_votes(frame(rows[:400]), str(path), buckets=16)
    files = {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    few = [r for r in rows[400:] if r[2] in (3, 5)]
    later = merge.upsert_votes(frame(few), str(path), buckets=16)
    got = {r.vote_id: (r.previous_value, r.new_score) for r in first.unionByName(later).collect()}
    assert {k: got[k] for k in range(400)} == {k: wanted[k] for k in range(400)}
    changed = {p.parent for p in files if not p.exists()}
    assert 1 <= len(changed) <= 2 and all(p.stat().st_mtime_ns == t for p, t in files.items() if p.parent not in changed), "untouched folders' files stay"
    again = merge.upsert_votes(frame(few), str(path), buckets=16)
    assert again.count() == 0, "the same votes again change nothing"
    stored = {(r.voter, r.target_id): r.value for r in spark.read.parquet(str(path)).collect()}
    now = {}
    for voter, _, target, value, _ in rows[:400] + few:
        now[voter, target] = value
    assert stored == now and merge.upsert_votes(frame(few).limit(0), str(path), buckets=16).count() == 0


def plain_mask(ids, start, end, newline, think):
    """Turn by turn, token by token."""
    n = len(ids)
    mask, segments, turn = [0] * n, [0] * n, 0

    def skip(at):
        while at < n and ids[at] in newline:
            at += 1
        return at

    for s in range(n):
        if ids[s] != start[0] or s + 2 >= n or ids[s + 1] != start[1]:
            continue
        begin = skip(s + 2)
        if think and begin < n and ids[begin] == think[0] and think[1] in ids[begin:]:
            begin = skip(ids.index(think[1], begin) + 1)
        stop = ids.index(end, begin) if end in ids[begin:] else n
        if stop <= begin:
            continue
        turn += 1
        for k in range(begin, stop):
            mask[k], segments[k] = 1, turn
    return mask, segments


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.lists(st.sampled_from([1, 2, 5, 7, 8, 9, 9, 20, 21]), max_size=30), min_size=1, max_size=6), st.booleans())
def test_masks_of_any_ids(rows, thinks):
    """9 8 begins a turn, 7 ends it, 5 is a line feed, 20 and 21 enclose thoughts: also with markers inside turns that haven't ended and inside thoughts."""
    think = (20, 21) if thinks else None
    ends = np.cumsum([len(r) for r in rows])
    mask, segments = K.response_masks(np.concatenate([np.array(r, dtype=np.int64) for r in rows]), ends, [9, 8], 7, {5}, think)
    for r, m, s in zip(rows, np.split(mask, ends[:-1]), np.split(segments, ends[:-1]), strict=True):
        assert (m.tolist(), s.tolist()) == plain_mask(r, [9, 8], 7, {5}, think)


def test_preparing_samples(spark):
    turn = lambda role, n: [9, role, 5] + [1] * n + [7]
    rows = [
        (1, turn(6, 2) + turn(8, 3) + turn(6, 1) + turn(8, 2), [0.5, -9.0], [True, True]), (2, turn(6, 2) + turn(8, 3), None, None), (3, turn(6, 2) + turn(8, 3), [1.0], [False]), (4, turn(6, 9), [1.0], [True]),
        (5, turn(8, 1) + turn(8, 1), [1.0], None), (6, turn(6, 30) + turn(8, 2) + turn(6, 1) + turn(8, 2), [1.0, 2.0], None), (7, None, [1.0], None), (8, turn(6, 2) + turn(8, 40), [1.0], None), (9, turn(6, 1) + turn(8, 2) + turn(6, 1) + turn(8, 2), [1.0, 2.0], [False, True]),
    ]
    df = spark.createDataFrame(rows, "k int, ids array<int>, turn_advantages array<double>, turn_trainable array<boolean>")
    out = K.prepare_samples(df, 9, 6, 8, 7, {5}, most=30, clip=2.5)
    got = {r.k: r for r in out.collect()}
    assert {k: (r.outcome, r.truncated) for k, r in got.items()} == {
        1: ("kept", False), 2: ("kept", False), 3: ("mask_empty", False), 4: ("turn_mismatch", False), 5: ("turn_mismatch", False), 6: ("kept", True), 7: ("turn_mismatch", False), 8: ("turn_mismatch", True), 9: ("kept", False),
    }
    assert sum(got[1].advantages) == 3 * 0.5 - 2 * 2.5
    assert got[6].ids == turn(6, 1) + turn(8, 2) and got[6].advantages == [0.0] * 8 + [2.0, 2.0, 0.0] and set(got[2].advantages) == {0.0}
    assert sum(got[9].mask) == 2 and sum(got[9].advantages) == 6.0 and got[3].advantages is None
    c = K.preparation_counts(out).first()
    assert (c.kept, c.truncated, c.mask_empty, c.turn_mismatch, c.max_tokens) == (4, 2, 1, 4, len(rows[0][1]))


def one_session(spark, n):
    """One session of four actors with a post each, then n votes by them on eight targets, again and again."""
    posts = spark.range(8).select(F.col("id").alias("post_id"), F.lit(1).alias("session_id"), F.concat(F.lit("u"), (F.col("id") % 4).cast("string")).alias("author"), F.lit("actor").alias("author_role"), F.lit("said").alias("content"), F.col("id").alias("created_at"))
    votes = spark.range(n).select(
        F.lit(1).alias("session_id"), (F.col("id") + 100).alias("created_at"), F.col("id").alias("vote_id"), F.concat(F.lit("u"), (F.col("id") % 4).cast("string")).alias("voter_name"), F.lit("actor").alias("voter_role"),
        F.concat(F.lit("u"), (F.col("id") % 4).cast("string")).alias("voter"), F.lit("post").alias("target_type"), (F.col("id") % 7).alias("target_id"), (F.col("id") % 3 - 1).alias("value"),
    )
    return posts, votes


def test_long_sessions(spark):
    """32,000 votes of four voters in one session: what each sees, and rows that don't widen with a viewer's history."""
    n = 32_000
    posts, votes = one_session(spark, n)
    viewers = posts.select("session_id", F.col("author").alias("viewer")).distinct()
    seen = V.viewer_running_scores(votes, viewers)
    last = {(r.viewer, r.target_id): r.s for r in seen.groupBy("viewer", "target_id").agg(F.max_by("cur_score", "vote_id").alias("s")).collect()}
    wanted = Counter()
    for k in range(n):
        for v in range(4):
            if k % 4 != v:
                wanted[f"u{v}", k % 7] += k % 3 - 1
    assert last == {key: wanted[key] for key in last} and len(last) == 28
    rows = J.viewed(J.session_entries(posts, None, votes))
    again = {(r.viewer, r.target_id): r.s for r in rows.filter("kind = 'vote' and author <> viewer").groupBy("viewer", "target_id").agg(F.max_by("cur_score", "place").alias("s")).collect()}
    assert again == last and rows.count() == 4 * (n + 8)
    assert {t.dataType.typeName() for t in rows.schema} <= {"integer", "long", "string", "boolean"}, "no arrays of a viewer's places or votes"
