"""What viewers and recipients get, worked out without a copy of each item for each of them, against plain copies."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tallyloom.operators import relational as R
from tallyloom.operators import trajectory as J
from tallyloom.operators import votes as V
from test_scale import one_session


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_delivery_digests(spark):
    rng = random.Random(4)
    rows = [(rng.randint(1, 3), rng.choice(["post", "vote"]), k, rng.choice(["a", "b", "c", "x", None]), rng.choice(["actor", "judge"])) for k in range(200)]
    items = spark.createDataFrame(rows, "session_id long, kind string, item_id long, author string, author_role string").withColumn("type_rank", F.when(F.col("kind") == "post", 0).otherwise(2))
    people = spark.createDataFrame([(s, w) for s in (1, 2, 3, 4) for w in ("a", "b", "c", "d")], "session_id long, recipient string")
    ordered = F.sum(F.col("item_id").cast("decimal(25,0)") * F.col("place").cast("decimal(10,0)")).cast("decimal(38,0)").alias("ordered")
    wanted = R.deliveries(items, people).groupBy("session_id", "recipient").agg(F.count("*").alias("n"), F.count_if(F.col("author") == "Anonymous Scientist").alias("n_anonymous"), ordered)
    got = R.delivery_digests(items, people)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect())) and got.count() == 12


def test_turns_taken(spark):
    posts, votes = one_session(spark, 300)
    posts = posts.withColumn("created_at", F.col("created_at") * 40 + 5)
    entries = J.session_entries(posts, None, votes)
    wanted = J.viewed(entries).filter("turn < turns").groupBy("session_id", "viewer", "turn").agg(F.count("*").alias("n"), F.max(F.when(F.col("is_self"), F.col("entry_id"))).alias("post_id"))
    got = J.turns_taken(entries).select("session_id", "viewer", "turn", F.col("place") - F.col("after"), "post_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect())) and got.count() == 8


def test_viewers_sums_are_not_sorted_as_copies(spark):
    """Viewers are told apart from voters by id, one votes on some targets, and no window stands above the copies for viewers."""
    rng = random.Random(8)
    rows = [(1, rng.choice([1, 2, 7, 8, 9]), "post", rng.randint(0, 3), rng.choice([-1, 1, 2]), k) for k in range(200)]
    votes = spark.createDataFrame(rows, "session_id long, voter long, target_type string, target_id long, value int, vote_id long")
    viewers = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "session_id long, viewer long")
    seen = V.viewer_running_scores(votes, viewers)
    sums, wanted = Counter(), []
    for _, voter, _, target, value, k in rows:
        for v in (1, 2, 3):
            if voter != v:
                sums[v, target] += value
                wanted.append((v, k, sums[v, target]))
    assert sorted((r.viewer, r.vote_id, r.cur_score) for r in seen.collect()) == sorted(wanted)
    lines = plan(seen).splitlines()
    assert not any(line.strip(" :+-").startswith("Window") and "viewer#" in line for line in lines)


def test_shared_samples(spark):
    """Own comments, own votes and re-votes on targets of one's own: samples cut out of the session's texts are those of a timeline for each viewer, and no window stands above copies for viewers."""
    rng = random.Random(5)
    who = ["ann", "bob", "cy"]
    posts = spark.createDataFrame([(k, 1 + k % 2, rng.choice(who), "actor", f"post number {k} said at length", 10 * k) for k in range(24)], "post_id long, session_id long, author string, author_role string, content string, created_at long")
    comments = spark.createDataFrame([(k, p, 1 + p % 2, rng.choice([*who, "dan"]), "actor", f"comment {k}", 10 * p + rng.randint(1, 60)) for k, p in enumerate(rng.choices(range(24), k=40))], "comment_id long, post_id long, session_id long, author string, author_role string, content string, created_at long")
    cast = [(k, 1 + p % 2, rng.choice([*who, "eve"]), "actor", "post", p, rng.choice([-1, 1]), rng.choice([None, 1]), 10 * p + rng.randint(1, 90)) for k, p in enumerate(rng.choices(range(24), k=90))]
    votes = spark.createDataFrame(cast, "vote_id long, session_id long, voter_name string, voter_role string, target_type string, target_id long, value int, previous_value int, created_at long")
    sessions = spark.createDataFrame([(1, "one"), (2, "two")], "session_id long, title string")
    rewards = posts.select("session_id", "post_id", F.col("post_id").cast("double").alias("reward"), (F.col("post_id") / 7).alias("advantage"))
    numbered = J.local_ids(J.view_posts(posts, True), "post_id")
    apart = J.timeline(numbered, J.local_comment_ids(J.view_comments(comments, posts, True), numbered), J.view_votes(votes, posts, True, True))
    shown = lambda entries: J.trajectories(entries, sessions, rewards)[0]
    shared = shown(J.session_entries(posts, comments, votes))
    rows = lambda df: sorted((r.session_id, r.actor, [(m.role, m.content) for m in r.messages], r.turn_rewards, r.turn_advantages, r.turn_post_ids, r.turn_trainable) for r in df.collect())
    assert rows(shared) == rows(shown(apart)) and shared.count() == 6
    assert not any(line.strip(" :+-").startswith("Window") and "viewer#" in line for line in plan(shared).splitlines())
