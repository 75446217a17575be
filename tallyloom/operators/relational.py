"""Joins and read views over sessions, posts, comments, votes and participants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_author(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Rows with their author's name and role; rows without a user go. Spark broadcasts users where their size allows."""
    return rows.join(users.select("user_id", F.col("name").alias("author"), F.col("role").alias("author_role")), "user_id")


def comments_in_sessions(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """Comments with the session of their post; comments without a post go."""
    return comments.join(posts.select("post_id", "session_id"), "post_id")


def votes_in_sessions(votes: DataFrame, posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Votes (target_type, target_id) with the session of their post or of their comment's post, null if there is none."""
    direct = posts.select(F.lit("post").alias("target_type"), F.col("post_id").alias("target_id"), "session_id")
    through = comments_in_sessions(comments.select("comment_id", "post_id"), posts)
    through = through.select(F.lit("comment").alias("target_type"), F.col("comment_id").alias("target_id"), "session_id")
    return votes.join(direct.union(through), ["target_type", "target_id"], "left")


def sessions_with_posts(sessions: DataFrame, posts: DataFrame) -> DataFrame:
    return sessions.join(posts, "session_id", "left_semi")


def session_stats(sessions: DataFrame, posts: DataFrame, comments: DataFrame, votes: DataFrame) -> DataFrame:
    """Sessions with n_posts, n_comments and n_votes: partial counts of all three kinds meet in one aggregation."""
    placed_comments = comments_in_sessions(comments, posts)
    placed_votes = votes_in_sessions(votes, posts, comments).filter("session_id is not null")
    kinds = [(posts, "p"), (placed_comments, "c"), (placed_votes, "v")]
    rows = None
    for frame, kind in kinds:
        part = frame.select("session_id", F.lit(kind).alias("kind"))
        rows = part if rows is None else rows.union(part)
    count = lambda k: F.count(F.when(F.col("kind") == k, 1))
    counts = rows.groupBy("session_id").agg(count("p").alias("n_posts"), count("c").alias("n_comments"), count("v").alias("n_votes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sessions.join(counts, "session_id", "left").select(*sessions.columns, *map(zero, ("n_posts", "n_comments", "n_votes")))


def forum_tree(posts: DataFrame, comments: DataFrame, scores: DataFrame, sort: str = "time") -> DataFrame:
    """Posts with their score, their comments as an array in order, and their number; ordered by time (id) or score.

    scores has (target_type, target_id, score); targets without votes score 0.
    """
    of = lambda kind, key: scores.filter(F.col("target_type") == kind).select(F.col("target_id").alias(key), "score")
    rated = comments.join(of("comment", "comment_id"), "comment_id", "left").withColumn("score", F.coalesce("score", F.lit(0)))
    nested = rated.groupBy("post_id").agg(F.sort_array(F.collect_list(F.struct("comment_id", "author", "content", "score"))).alias("comments"))
    empty = F.array().cast(nested.schema["comments"].dataType)
    tree = posts.join(of("post", "post_id"), "post_id", "left").join(nested, "post_id", "left")
    tree = tree.select(*posts.columns, F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("comments", empty).alias("comments"))
    tree = tree.withColumn("comment_count", F.size("comments"))
    return tree.orderBy(F.col("score").desc(), "post_id") if sort == "score" else tree.orderBy("post_id")


def actor_sessions(sessions: DataFrame, posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Sessions with an array of the posts of actors, each with the array of its comments by actors, in the order of ids; both may be empty."""
    own = lambda rows: rows.filter("author_role = 'actor'")
    nested = own(comments).groupBy("post_id").agg(F.sort_array(F.collect_list(F.struct("comment_id", "author", "content"))).alias("comments"))
    none = F.array().cast(nested.schema["comments"].dataType)
    told = own(posts).join(nested, "post_id", "left").withColumn("comments", F.coalesce("comments", none))
    listed = told.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("post_id", "author", "content", "comments"))).alias("posts"))
    return sessions.join(listed, "session_id", "left").withColumn("posts", F.coalesce("posts", F.array().cast(listed.schema["posts"].dataType)))


def actors_by_name(posts: DataFrame) -> DataFrame:
    """(session_id, names): the actors with posts, in the order of their names."""
    return posts.filter("author_role = 'actor'").groupBy("session_id").agg(F.sort_array(F.collect_set("author")).alias("names"))


def cohort_names(*cohorts: DataFrame) -> DataFrame:
    """The names of all cohorts, each once."""
    out = cohorts[0]
    for more in cohorts[1:]:
        out = out.union(more)
    return out.distinct()


def open_sessions(states: DataFrame) -> DataFrame:
    return states.filter("status = 'open'")


def listed(rows: DataFrame, group: str, key: str) -> DataFrame:
    """(group, ids): the keys of each group's rows, ascending, as its listing gives them."""
    return rows.groupBy(group).agg(F.sort_array(F.collect_list(key)).alias("ids"))


def post_detail(posts: DataFrame, comments: DataFrame, scores: DataFrame, session_id, post_id) -> DataFrame:
    """One post of a session with its comments; the point filters reach the scans."""
    one = posts.filter((F.col("session_id") == session_id) & (F.col("post_id") == post_id))
    return forum_tree(one, comments.filter(F.col("post_id") == post_id), scores)


def session_detail(sessions: DataFrame, session_id, include_solution: bool = False) -> DataFrame:
    one = sessions.filter(F.col("session_id") == session_id)
    return one if include_solution else one.drop("reference_solution")


def public_users(users: DataFrame) -> DataFrame:
    return users.drop("api_key")


def user_state(posts: DataFrame, comments: DataFrame, votes: DataFrame) -> DataFrame:
    """For each session and user: a map of targets (`post:1`) to the user's current vote, and own post and comment ids."""
    placed = votes_in_sessions(votes, posts, comments).filter("session_id is not null")
    target = F.concat_ws(":", "target_type", "target_id")
    cast = placed.groupBy("session_id", F.col("voter").alias("user_id")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(target.alias("k"), F.col("value").alias("v"))))).alias("votes"))
    ids = lambda df, key: df.groupBy("session_id", "user_id").agg(F.sort_array(F.collect_list(key)).alias(f"{key}s"))
    own_posts, own_comments = ids(posts, "post_id"), ids(comments_in_sessions(comments, posts), "comment_id")
    return cast.join(own_posts, ["session_id", "user_id"], "full").join(own_comments, ["session_id", "user_id"], "full")


def participants(events: DataFrame) -> DataFrame:
    """Current participants from join and leave events (session_id, user_id, kind, seq, at, reason): the last event counts;
    joining again clears what leaving set."""
    last = events.groupBy("session_id", "user_id").agg(F.max_by(F.struct("kind", "at", "reason"), "seq").alias("last"), F.max(F.when(F.col("kind") == "join", F.col("at"))).alias("joined_at"))
    left = F.col("last.kind") == "leave"
    return last.select(
        "session_id", "user_id", F.when(left, "left").otherwise("active").alias("status"), "joined_at",
        F.when(left, F.col("last.at")).alias("left_at"), F.when(left, F.col("last.reason")).alias("leave_reason"),
    )


def session_states(sessions: DataFrame, closings: DataFrame) -> DataFrame:
    """Sessions with status closed where a closing event names them."""
    closed = closings.select("session_id").distinct().withColumn("_closed", F.lit(True))
    return sessions.join(closed, "session_id", "left").withColumn("status", F.when(F.col("_closed"), "closed").otherwise(F.coalesce("status", F.lit("open")))).drop("_closed")


def first_users(users: DataFrame, role: str, n: int) -> DataFrame:
    return users.filter(F.col("role") == role).orderBy("user_id").limit(n)


def new_items(rows: DataFrame, key: str, after: int) -> DataFrame:
    """Rows beyond a cursor; the cursor's next value is the largest key."""
    return rows.filter(F.col(key) > after)


def deliveries(items: DataFrame, recipients: DataFrame) -> DataFrame:
    """Each item for each recipient of its session but its own author, judges' votes without their name, in delivery order
    (type, then id)."""
    author = F.when((F.col("kind") == "vote") & (F.col("author_role") == "judge"), "Anonymous Scientist").otherwise(F.col("author"))
    joined = items.join(recipients.select("session_id", "recipient"), "session_id").filter(~F.col("author").eqNullSafe(F.col("recipient")))
    place = F.row_number().over(Window.partitionBy("session_id", "recipient").orderBy("type_rank", "item_id"))
    return joined.withColumn("author", author).withColumn("place", place)


def delivery_digests(items: DataFrame, recipients: DataFrame) -> DataFrame:
    """(session_id, recipient, n, n_anonymous, ordered): what the rows of `deliveries` come to for each recipient, ordered being the sum of item_id times place.

    A recipient gets the session's items but its own, so its sums are the session's less those of its own items, and less the places that each own item before
    it takes from another's: what follows an own item, but for further own items, counts once less. No item is copied for its recipients.
    """
    wide = lambda c: F.col(c).cast("decimal(25,0)")
    order = ("type_rank", "item_id")
    upto = Window.partitionBy("session_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    judged = (F.col("kind") == "vote") & (F.col("author_role") == "judge")
    placed = items.withColumn("_judged", judged).withColumn("_item", wide("item_id")).withColumn("_place", F.row_number().over(Window.partitionBy("session_id").orderBy(*order))).withColumn("_upto", F.sum("_item").over(upto))
    by_place = F.sum(F.col("_item") * F.col("_place").cast("decimal(10,0)")).cast("decimal(38,0)")
    counts = [F.count("*").alias("n"), F.count_if("_judged").alias("n_anonymous"), by_place.alias("by_place"), F.sum("_item").cast("decimal(38,0)").alias("items")]
    total = placed.groupBy("session_id").agg(*counts)
    nth = F.row_number().over(Window.partitionBy("session_id", "author").orderBy("_place")) - 1
    own = placed.withColumn("_nth", nth).groupBy("session_id", F.col("author").alias("recipient")).agg(
        *counts, F.sum("_upto").cast("decimal(38,0)").alias("upto"), F.sum(F.col("_item") * F.col("_nth").cast("decimal(10,0)")).cast("decimal(38,0)").alias("own_after")
    )
    rows = recipients.select("session_id", "recipient").join(total.alias("t"), "session_id").join(own.alias("o"), ["session_id", "recipient"], "left")
    known = lambda c: F.coalesce(F.col(f"o.{c}"), F.lit(0).cast("decimal(38,0)"))
    following = F.coalesce(F.col("o.n"), F.lit(0)).cast("decimal(12,0)") * F.col("t.items") - known("upto") - known("own_after")
    out = rows.select("session_id", "recipient", *((F.col(f"t.{c}") - F.coalesce(F.col(f"o.{c}"), F.lit(0))).alias(c) for c in ("n", "n_anonymous")), (F.col("t.by_place") - known("by_place") - following).cast("decimal(38,0)").alias("ordered"))
    return out.filter("n > 0")


def newest_first(sessions: DataFrame, time: str = "created_at", key: str = "session_id") -> DataFrame:
    return sessions.orderBy(F.col(time).desc(), key)


def missing_keys(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Keys of base that other lacks."""
    return base.select(key).distinct().join(other, key, "left_anti")


def rendered_items(items: DataFrame) -> DataFrame:
    """(session_id, text): items (type_rank, item_id, line) of each session joined by blank lines in delivery order."""
    listed = F.sort_array(F.collect_list(F.struct("type_rank", "item_id", "line")))
    return items.groupBy("session_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n\n").alias("text"))


def runs_named(runs: DataFrame, part: str, name: str = "run") -> DataFrame:
    """Runs whose name holds a text."""
    return runs.filter(F.contains(F.col(name), F.lit(part)))
