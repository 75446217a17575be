"""Views, folds, rewards and trajectories on small forums."""

import random
from collections import defaultdict
from statistics import mean, pstdev

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import relational as R
from tallyloom.operators import rewards as W
from tallyloom.operators import trajectory as J
from tallyloom.operators import votes as V

LONG = "a sentence that is long enough"


def posts(spark, rows):
    """rows: (post_id, session, author, content, second)"""
    data = [(p, s, a, "judge" if a.startswith("J") else "actor", c, f"2024-01-01 00:00:{t:02d}") for p, s, a, c, t in rows]
    return spark.createDataFrame(data, "post_id long, session_id long, author string, author_role string, content string, at string").withColumn("created_at", F.to_timestamp("at")).drop("at")


def comments(spark, rows):
    """rows: (comment_id, post_id, author, content, second)"""
    data = [(k, p, a, "actor", c, f"2024-01-01 00:00:{t:02d}") for k, p, a, c, t in rows]
    return spark.createDataFrame(data, "comment_id long, post_id long, author string, author_role string, content string, at string").withColumn("created_at", F.to_timestamp("at")).drop("at")


def votes(spark, rows):
    """rows: (vote_id, voter, target_type, target_id, value, second)"""
    data = [(k, v, v, "judge" if v.startswith("J") else "actor", t, i, x, f"2024-01-01 00:00:{s:02d}") for k, v, t, i, x, s in rows]
    schema = "vote_id long, voter string, voter_name string, voter_role string, target_type string, target_id long, value int, at string"
    return spark.createDataFrame(data, schema).withColumn("created_at", F.to_timestamp("at")).drop("at")


def sessions(spark, ids=(1,)):
    return spark.createDataFrame([(i, f"Title {i} by Scientist_2") for i in ids], "session_id long, title string")


def rewards_of(p):
    return W.debias_position(W.with_positions(p))


def test_local_ids_and_orphans(spark):
    p = posts(spark, [(7, 1, "Ann", "x", 1), (99, 1, "Ann", "y", 2)])
    numbered = J.local_ids(J.view_posts(p, True), "post_id")
    assert {r.post_id: r.local_id for r in numbered.collect()} == {7: 1, 99: 2}
    c = comments(spark, [(5, 7, "Bob", "x", 3), (6, 999, "Bob", "x", 3)]).withColumn("session_id", F.lit(1).cast("long")).withColumn("viewer", F.lit("Ann"))
    assert {r.comment_id: (r.local_id, r.local_post_id) for r in J.local_comment_ids(c, numbered).collect()} == {5: (1, 1), 6: (2, 0)}


def test_reward_counts_judges_votes_on_posts(spark):
    p = posts(spark, [(1, 1, "Ann", "x", 1), (2, 1, "Bob", "y", 2), (3, 1, "Bob", "z", 3)])
    v = votes(spark, [(1, "J1", "post", 1, 2, 4), (2, "Bob", "post", 1, -1, 4), (3, "J1", "post", 2, 3, 4), (4, "J1", "comment", 3, 3, 4)])
    assert {r.post_id: r.reward for r in W.post_rewards(p, v).collect()} == {1: 2.0, 2: 3.0, 3: 0.0}


def test_a_vote_replaces_the_one_before(spark):
    v = votes(spark, [(1, "J1", "post", 1, 1, 1), (5, "J1", "post", 1, -1, 2), (9, "J1", "post", 1, 1, 3), (2, "J2", "post", 1, 3, 1)])
    last = {r.voter: (r.vote_id, r.value, r.previous_value) for r in V.latest_votes(v).collect()}
    assert last == {"J1": (9, 1, -1), "J2": (2, 3, None)}
    assert {r.voter: r.value for r in V.current_values(v).collect()} == {"J1": 1, "J2": 3}
    assert {r.vote_id: r.previous_value for r in V.vote_history(v).collect()} == {1: None, 5: 1, 9: -1, 2: None}
    assert V.scores(V.current_values(v)).first().score == 4


def test_own_votes_stay_out_of_the_running_score(spark):
    v = votes(spark, [(1, "Ann", "post", 1, 1, 1), (2, "Bob", "post", 1, 1, 2), (3, "J1", "post", 1, -3, 3)]).withColumn("session_id", F.lit(1))
    viewers = spark.createDataFrame([(1, "Ann"), (1, "Bob")], "session_id int, viewer string")
    seen = {(r.viewer, r.vote_id): r.cur_score for r in V.viewer_running_scores(v, viewers).collect()}
    assert seen == {("Ann", 2): 1, ("Ann", 3): -2, ("Bob", 1): 1, ("Bob", 3): -2}
    assert {r.vote_id: r.cur_score for r in V.running_scores(v).collect()} == {1: 1, 2: 2, 3: -1}


@pytest.mark.parametrize("value,role,owner,voter,reason", [(0, "judge", 1, 2, "zero"), (None, "judge", 1, 2, "zero"), (3, "judge", 1, 2, None), (-4, "judge", 1, 2, "range"), (2, "actor", 1, 2, "range"), (2, "admin", 1, 2, "range"), (1, "actor", None, 2, "no_target"), (1, "actor", 2, 2, "own_target"), (-1, "actor", 1, 2, None)])
def test_vote_domain(spark, value, role, owner, voter, reason):
    row = spark.createDataFrame([(value, role, owner, voter)], "v int, r string, o long, w long")
    assert row.select(V.vote_reason(F.col("v"), F.col("r"), F.col("o"), F.col("w"))).first()[0] == reason


def views(spark, coupled, visible):
    p = posts(spark, [(1, 1, "Ann", "x", 1), (2, 1, "Bob", "y", 2), (3, 1, "Ann", "z", 3)])
    c = R.comments_in_sessions(comments(spark, [(1, 2, "Ann", "hm", 3)]), p)
    v = R.votes_in_sessions(votes(spark, [(1, "J1", "post", 1, 1, 4), (2, "J1", "post", 2, 1, 4), (3, "J1", "post", 3, -1, 4), (4, "Bob", "post", 1, 1, 4), (5, "J1", "comment", 1, 1, 4)]), p, comments(spark, [(1, 2, "Ann", "hm", 3)]))
    ann = lambda df, key: sorted(r[key] for r in df.filter("viewer = 'Ann'").collect())
    return ann(J.view_posts(p, coupled), "post_id"), ann(J.view_comments(c, p, coupled), "comment_id"), ann(J.view_votes(v, p, coupled, visible), "vote_id")


@pytest.mark.parametrize("coupled,visible,expected", [(True, True, ([1, 2, 3], [1], [1, 2, 3, 4, 5])), (True, False, ([1, 2, 3], [1], [4])), (False, True, ([1, 3], [], [1, 3])), (False, False, ([1, 3], [], []))])
def test_the_four_views(spark, coupled, visible, expected):
    assert views(spark, coupled, visible) == expected


def test_timeline_puts_posts_before_comments_before_votes(spark):
    p = J.local_ids(J.view_posts(posts(spark, [(1, 1, "Ann", "x", 5), (2, 1, "Ann", "y", 5)]), True), "post_id")
    c = J.local_comment_ids(R.comments_in_sessions(comments(spark, [(1, 1, "Bob", "z", 5)]), p.drop("viewer")).withColumn("viewer", F.lit("Ann")), p)
    v = votes(spark, [(1, "J1", "post", 1, 1, 5), (2, "J1", "post", 77, 1, 5)]).withColumn("session_id", F.lit(1).cast("long")).withColumn("viewer", F.lit("Ann")).withColumn("previous_value", F.lit(None).cast("int"))
    rows = J.timeline(p, c, v).orderBy("created_at", "type_rank", "order_id").collect()
    assert [(r.kind, r.entry_id) for r in rows] == [("post", 1), ("post", 2), ("comment", 1), ("vote", 1)]
    assert {r.kind for r in J.timeline(p, c).collect()} == {"post", "comment"}


def trajectory(spark, rows, vote_rows=(), comment_rows=(), coupled=True, names=None):
    p = posts(spark, rows)
    current = V.latest_votes(votes(spark, list(vote_rows)))
    scored = W.advantages(rewards_of(W.post_rewards(p, current))).select("post_id", "reward", "advantage")
    numbered = J.local_ids(J.view_posts(p, coupled), "post_id")
    c = J.local_comment_ids(J.view_comments(R.comments_in_sessions(comments(spark, list(comment_rows)), p), p, coupled), numbered) if coupled else None
    return p, current, numbered, c, scored


VOTED = [(1, "J1", "post", 1, 2, 2)]
TALK = [(1, 1, "Ann", LONG + " one", 1), (2, 1, "Bob", "I scored this and voted, " + LONG, 2), (3, 1, "Ann", LONG + " two", 3), (4, 1, "Bob", LONG + " trailing", 9)]


def test_turns_hold_what_came_before_them(spark):
    _, _, numbered, c, scored = trajectory(spark, TALK, VOTED, [(1, 1, "Bob", "a comment", 2), (2, 2, "Ann", "own comment", 2)])
    samples, dropped = J.trajectories(J.timeline(numbered, c), sessions(spark), scored)
    ann = samples.filter("actor = 'Ann'").first()
    assert [m.role for m in ann.messages] == ["user", "assistant"] * 2
    assert ann.messages[1].content == LONG + " one" and "I scored this" in ann.messages[2].content and "a comment" in ann.messages[2].content
    assert "own comment" in ann.messages[2].content and "(you)" in ann.messages[2].content and not any("trailing" in m.content for m in ann.messages)
    assert "Title 1" in ann.messages[0].content and "+2" not in "".join(m.content for m in ann.messages)
    assert ann.turn_post_ids == [1, 3] and ann.turn_rewards == [2.0, 0.0] and any(ann.turn_advantages) and ann.turn_trainable == [True, True]
    assert dropped.first().asDict() == {"zero_turns": 0, "all_short": 0}


def test_votes_are_shown_where_they_are_spoken_of(spark):
    p, current, numbered, c, scored = trajectory(spark, TALK, VOTED + [(2, "Bob", "post", 1, 1, 2)])
    placed = R.votes_in_sessions(current, p, comments(spark, []))
    seen = J.votes_if_mentioned(J.view_votes(placed, p, True, True), numbered, c, text.VOTE_LANGUAGE)
    named = J.anonymous_voters(seen, sessions(spark))
    plain, _ = J.trajectories(J.timeline(numbered, c), sessions(spark), scored)
    shown, _ = J.trajectories(J.timeline(numbered, c, named), sessions(spark), scored)
    user = lambda s: "".join(m.content for m in s.filter("actor = 'Ann'").first().messages if m.role == "user")
    assert len(user(shown)) > len(user(plain)) and "+2" in user(shown) and "+3" in user(shown) and "J1" not in user(shown)
    bob = "".join(m.content for m in shown.filter("actor = 'Bob'").first().messages)
    assert "Bob on" not in bob, "own votes aren't shown"
    silent = J.votes_if_mentioned(J.view_votes(placed, p, True, True), numbered.filter("post_id <> 2"), None, text.VOTE_LANGUAGE)
    assert silent.count() == 0


def test_solo_view_and_names(spark):
    rows = [(1, 1, "Scientist_1", "Scientist_2 and Scientist_9 said " + LONG, 1), (2, 1, "Scientist_2", LONG, 2), (5, 1, "Scientist_1", LONG, 3)]
    _, _, numbered, _, scored = trajectory(spark, rows, coupled=False)
    names = spark.createDataFrame([(1, "Scientist_1", "Scientist_2"), (1, "Scientist_2", "Nia")], "session_id long, name string, alias string")
    samples, _ = J.trajectories(J.timeline(numbered), sessions(spark), scored, names, coupled=False)
    got = {r.actor: r for r in samples.collect()}
    assert got.keys() == {"Scientist_2", "Nia"} and got["Scientist_2"].turn_post_ids == [1, 5]
    assert got["Scientist_2"].messages[1].content.startswith("Nia and Scientist_9 said"), "a name put in isn't replaced again"
    assert "by Nia" in got["Nia"].messages[0].content and LONG not in got["Scientist_2"].messages[2].content


@pytest.mark.parametrize("contents,stats,kept", [(["ok."], 1, 0), ([LONG], 0, 1), (["ok.", LONG], 0, 1), (["x" * 19], 1, 0), (["x" * 20], 0, 1), ["　" + "é" * 20 + " ", 0, 1] if False else (["　" + "é" * 20 + " "], 0, 1), ([" " + "−" * 19 + " "], 1, 0)])
def test_short_turns(spark, contents, stats, kept):
    _, _, numbered, c, scored = trajectory(spark, [(k, 1, "Ann", x, k) for k, x in enumerate(contents, 1)])
    samples, dropped = J.trajectories(J.timeline(numbered, c), sessions(spark), scored)
    assert dropped.first().all_short == stats and samples.count() == kept
    if kept:
        assert samples.first().turn_trainable == [len(x.strip()) >= 20 for x in contents]


def test_sessions_with_too_few_samples_go(spark):
    df = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c")], "session_id string, actor string")
    assert J.enough_samples(df, 2).count() == 2


def forum(spark, seed, sizes):
    rng = random.Random(seed)
    rows, vote_rows, k = [], [], 0
    for s, n in enumerate(sizes):
        for _ in range(n):
            k += 1
            rows.append((k, s, f"A{rng.randint(1, 3)}", LONG, rng.randint(0, 59)))
            for j in range(3):
                if rng.random() < 0.7:
                    vote_rows.append((1000 * k + j, f"J{j}", "post", k, rng.choice([-3, -2, -1, 1, 2, 3]), 59))
    return rows, vote_rows


def plain_advantages(rows, vote_rows, baseline, scale):
    by = defaultdict(list)
    reward = {p: float(sum(v[4] for v in vote_rows if v[3] == p)) for p, *_ in rows}
    for p, s, *_ in sorted(rows):
        by[s].append(p)
    t = {p: k / max(len(ps) - 1, 1) for ps in by.values() for k, p in enumerate(ps)}
    fit = [(t[p], reward[p]) for ps in by.values() if len(ps) >= 4 for p in ps]
    slope = 0.0
    if len(fit) >= 4:
        mt, mr = mean(x for x, _ in fit), mean(y for _, y in fit)
        sxx = sum((x - mt) ** 2 for x, _ in fit)
        slope = sum((x - mt) * (y - mr) for x, y in fit) / sxx if sxx >= 1e-9 else 0.0
    r = {p: x if abs(slope) < 0.01 else x - slope * (t[p] - 0.5) for p, x in reward.items()}
    std = lambda xs: 1.0 if len(xs) <= 1 else max(pstdev(xs), 1.0)
    out = {}
    for ps in by.values():
        own = [r[p] for p in ps]
        for p in ps:
            base = {"mean_session": mean(own), "mean_global": mean(r.values())}.get(baseline)
            if base is None:
                try:
                    base = float(baseline)
                except (TypeError, ValueError):
                    base = 0.0
            if scale in (None, "session_std"):
                by_ = std(own)
            elif scale == "global_std":
                by_ = std(list(r.values()))
            else:
                try:
                    by_ = float(scale)
                except ValueError:
                    by_ = 1.0
            out[p] = (r[p] - base) / by_
    return out


@pytest.mark.parametrize("baseline,scale", [("mean_session", "session_std"), ("mean_global", "global_std"), (2, "none"), ("0.5", "2"), ("what", "what"), (None, None), ("mean_session", 4), ("mean_global", "session_std")])
def test_advantage_options(spark, baseline, scale):
    rows, vote_rows = forum(spark, 4, [0, 1, 3, 4, 9, 12])
    scored = rewards_of(W.post_rewards(posts(spark, rows), votes(spark, vote_rows)))
    got = {r.post_id: r.advantage for r in W.advantages(scored, baseline, scale).collect()}
    assert got == pytest.approx(plain_advantages(rows, vote_rows, baseline, scale), abs=1e-9)


def test_a_zero_scale_is_an_error(spark):
    scored = rewards_of(W.post_rewards(posts(spark, [(1, 1, "Ann", "x", 1)]), votes(spark, [])))
    with pytest.raises(ZeroDivisionError):
        W.advantages(scored, scale="0")
    assert W.advantages(scored).first().advantage == 0.0


def test_no_slope_without_enough_posts(spark):
    for sizes in ([], [1], [3, 3], [2]):
        rows, vote_rows = forum(spark, 1, sizes)
        p = W.with_positions(W.post_rewards(posts(spark, rows), votes(spark, vote_rows)))
        assert W.position_slope(p).first().slope == 0.0
    flat = W.with_positions(W.post_rewards(posts(spark, [(k, 1, "Ann", "x", k) for k in range(6)]), votes(spark, [])))
    assert W.debias_position(flat).filter("debiased <> 0").count() == 0


@pytest.mark.parametrize("n", [1, 2, 10, 11, 500])
def test_quantiles_by_index(spark, n):
    rng = random.Random(n)
    xs = [rng.randint(0, n // 2 + 1) / 4 for _ in range(n)]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double")
    wanted = [sorted(xs)[int(p * (n - 1))] for p in (0.1, 0.5, 0.9)]
    assert list(W.indexed_quantiles(df, "x", [0.1, 0.5, 0.9]).first()) == wanted


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_partitioning_changes_nothing(spark, parts):
    rows, vote_rows = forum(spark, 8, [5, 6, 1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        _, _, numbered, c, scored = trajectory(spark, rows, vote_rows)
        samples, _ = J.trajectories(J.timeline(numbered, c), sessions(spark, (0, 1, 2)), scored)
        got = sorted((r.session_id, r.actor, tuple(m.content for m in r.messages), tuple(r.turn_advantages)) for r in samples.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    test_partitioning_changes_nothing.seen = getattr(test_partitioning_changes_nothing, "seen", got)
    assert got == test_partitioning_changes_nothing.seen and len(got) > 3
    for _, _, messages, adv in got:
        assert len(messages) == 2 * len(adv)


def test_participants_and_sessions(spark):
    e = spark.createDataFrame([(1, 1, "join", 1, "t1", None), (1, 1, "leave", 2, "t2", "bored"), (1, 1, "join", 3, "t3", None), (1, 2, "join", 1, "t1", None), (1, 2, "leave", 5, "t5", "done")], "session_id int, user_id int, kind string, seq int, at string, reason string")
    got = {r.user_id: (r.status, r.joined_at, r.left_at, r.leave_reason) for r in R.participants(e).collect()}
    assert got == {1: ("active", "t3", None, None), 2: ("left", "t1", "t5", "done")}
    s = spark.createDataFrame([(1, None), (2, "open")], "session_id int, status string")
    assert {r.session_id: r.status for r in R.session_states(s, spark.createDataFrame([(2,), (2,)], "session_id int")).collect()} == {1: "open", 2: "closed"}


def test_tree_and_detail(spark):
    p = posts(spark, [(1, 1, "Ann", "x", 1), (2, 1, "Bob", "y", 2), (3, 1, "Bob", "z", 3)])
    c = comments(spark, [(2, 1, "Bob", "later", 3), (1, 1, "Ann", "first", 2)])
    s = V.scores(votes(spark, [(1, "J1", "post", 3, 2, 4), (2, "J1", "comment", 2, -1, 4)]))
    tree = R.forum_tree(p, c, s, "score").collect()
    assert [(r.post_id, r.score, r.comment_count) for r in tree] == [(3, 2, 0), (1, 0, 2), (2, 0, 0)]
    assert [(x.comment_id, x.score) for x in tree[1].comments] == [(1, 0), (2, -1)]
    assert R.post_detail(p, c, s, 1, 3).first().score == 2 and R.post_detail(p, c, s, 2, 3).count() == 0
    users = spark.createDataFrame([(1, "Ann", "actor", "k")], "user_id int, name string, role string, api_key string")
    assert R.public_users(users).columns == ["user_id", "name", "role"]
    detail = spark.createDataFrame([(1, "t", "secret")], "session_id int, title string, reference_solution string")
    assert "reference_solution" not in R.session_detail(detail, 1).columns and R.session_detail(detail, 1, True).first().reference_solution == "secret"


def test_permissions(spark):
    df = spark.createDataFrame([("post", "judge", "open"), ("vote", "judge", "open"), ("comment", "actor", "closed"), ("post", "actor", None), ("post", "actor", "open")], "a string, r string, s string")
    assert [r[0] for r in df.select(V.action_reason(F.col("a"), F.col("r"), F.col("s"))).collect()] == ["role", None, "closed", "no_session", None]
