"""Viewers' timelines, their segmentation into turns, and chat-shaped training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.templates import pick
from ..functions.text import score_text, strip, substitute_names

#: Order of entries of one time.
TYPE_RANK = {"post": 0, "comment": 1, "vote": 2}
#: A turn of fewer characters isn't trained on.
LEAST_CHARS = 20


def actors(posts: DataFrame) -> DataFrame:
    """(session_id, viewer) of all actors with posts."""
    return posts.filter("author_role = 'actor'").select("session_id", F.col("author").alias("viewer")).distinct()


def view_posts(posts: DataFrame, coupled: bool) -> DataFrame:
    """Posts with their viewer: all of the session for each of its actors, or only the actor's own."""
    if coupled:
        return posts.join(actors(posts), "session_id")
    return posts.filter("author_role = 'actor'").withColumn("viewer", F.col("author"))


def view_comments(comments: DataFrame, posts: DataFrame, coupled: bool) -> DataFrame:
    """Comments (with session_id) with their viewer; none unless coupled."""
    if coupled:
        return comments.join(actors(posts), "session_id")
    return comments.withColumn("viewer", F.col("author")).limit(0)


def view_votes(votes: DataFrame, posts: DataFrame, coupled: bool, judges_visible: bool) -> DataFrame:
    """Votes (with session_id) with their viewer: actors' and, if visible, judges' votes; solo, judges' votes on own posts."""
    if coupled:
        shown = votes.filter("voter_role = 'actor' or voter_role = 'judge'") if judges_visible else votes.filter("voter_role = 'actor'")
        return shown.join(actors(posts), "session_id")
    own = posts.filter("author_role = 'actor'").select(F.col("post_id").alias("target_id"), F.col("author").alias("viewer"))
    judged = votes.filter("voter_role = 'judge' and target_type = 'post'").join(own, "target_id")
    return judged if judges_visible else judged.limit(0)


def local_ids(rows: DataFrame, key: str, name: str = "local_id") -> DataFrame:
    """Numbers from 1 in the order of key in each view."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy("session_id", "viewer").orderBy(key)))


def local_comment_ids(comments: DataFrame, numbered_posts: DataFrame) -> DataFrame:
    """Comments with local_id and local_post_id, 0 where the post isn't in the view."""
    of_posts = numbered_posts.select("session_id", "viewer", "post_id", F.col("local_id").alias("local_post_id"))
    joined = local_ids(comments, "comment_id").join(of_posts, ["session_id", "viewer", "post_id"], "left")
    return joined.withColumn("local_post_id", F.coalesce("local_post_id", F.lit(0)))


def timeline(posts: DataFrame, comments: DataFrame | None = None, votes: DataFrame | None = None, view: tuple[str, ...] = ("session_id", "viewer")) -> DataFrame:
    """The union of numbered posts, numbered comments and votes of each view. Sort order: created_at, type_rank, order_id.

    A vote stays only if its target is in the view.
    """
    names = [*view, "created_at"]
    out = posts.select(*names, F.lit(0).alias("type_rank"), F.col("local_id").cast("long").alias("order_id"), F.lit("post").alias("kind"), F.col("post_id").alias("entry_id"), "author", "author_role", "content", "local_id")
    if comments is not None:
        part = comments.select(*names, F.lit(1).alias("type_rank"), F.col("local_id").cast("long").alias("order_id"), F.lit("comment").alias("kind"), F.col("comment_id").alias("entry_id"), "author", "author_role", "content", "local_id", "local_post_id")
        out = out.unionByName(part, allowMissingColumns=True)
    if votes is not None:
        targets = posts.select(*view, F.lit("post").alias("target_type"), F.col("post_id").alias("target_id"), F.col("local_id").alias("target_local_id"))
        if comments is not None:
            targets = targets.union(comments.select(*view, F.lit("comment"), "comment_id", "local_id"))
        part = votes.join(targets, [*view, "target_type", "target_id"])
        part = part.select(*names, F.lit(2).alias("type_rank"), F.col("vote_id").alias("order_id"), F.lit("vote").alias("kind"), F.col("vote_id").alias("entry_id"), F.col("voter_name").alias("author"), F.col("voter_role").alias("author_role"), "value", "previous_value", "target_type", "target_id", "target_local_id")
        out = out.unionByName(part, allowMissingColumns=True)
    return out


_ORDER = ("created_at", "type_rank", "order_id", "entry_id", "author")


def session_entries(posts: DataFrame, comments: DataFrame | None = None, votes: DataFrame | None = None) -> DataFrame:
    """The timeline that all viewers of a session share, numbered and put in order once: local ids and place from 1. comments and votes have session_id."""
    session = Window.partitionBy("session_id")
    numbered = posts.withColumn("local_id", F.row_number().over(session.orderBy("post_id")))
    if comments is not None:
        of_posts = numbered.select("session_id", "post_id", F.col("local_id").alias("local_post_id"))
        comments = comments.withColumn("local_id", F.row_number().over(session.orderBy("comment_id"))).join(of_posts, ["session_id", "post_id"], "left")
        comments = comments.withColumn("local_post_id", F.coalesce("local_post_id", F.lit(0)))
    if votes is not None and "previous_value" not in votes.columns:
        votes = votes.withColumn("previous_value", F.lit(None).cast("int"))
    entries = timeline(numbered, comments, votes, ("session_id",))
    return entries.withColumn("place", F.row_number().over(session.orderBy(*_ORDER)))


def viewed(entries: DataFrame) -> DataFrame:
    """Session entries as each of the session's actors with posts sees them, with the columns of turn_segments and, for votes of others, cur_score.

    A viewer's row for an entry holds nothing of the viewer's other rows: the turn is a running count of own posts, and cur_score a running sum of the votes of others on
    the target, both over the rows of one viewer in the order of places. So time and space grow with the rows that are shown, however many posts and
    votes a viewer has.
    """
    own = (F.col("kind") == "post") & (F.col("author_role") == "actor")
    viewers = entries.filter(own).groupBy("session_id", F.col("author").alias("viewer")).agg(F.count("*").alias("turns"))
    rows = entries.join(viewers, "session_id").withColumn("is_self", own & (F.col("author") == F.col("viewer")))
    by = Window.partitionBy("session_id", "viewer")
    if "value" in entries.columns:
        of_target = Window.partitionBy("session_id", "viewer", "target_type", "target_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        others = F.when(F.col("author") != F.col("viewer"), F.col("value").cast("long"))
        rows = rows.withColumn("cur_score", F.when(F.col("kind") == "vote", F.sum(others).over(of_target)))
    before = F.sum(F.col("is_self").cast("int")).over(by.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("turn", F.coalesce(before, F.lit(0)))


def turns_taken(entries: DataFrame) -> DataFrame:
    """(session_id, viewer, turn, after, place, post_id): each actor's own posts in session entries, turn counting from 0.

    A turn is the entries of the places beyond `after` up to `place`, that of the own post, so it stands for what `viewed` shows in it and no entry is copied for its viewers.
    """
    own = entries.filter("kind = 'post' and author_role = 'actor'").select("session_id", F.col("author").alias("viewer"), "place", F.col("entry_id").alias("post_id"))
    by = Window.partitionBy("session_id", "viewer").orderBy("place")
    return own.select("session_id", "viewer", (F.row_number().over(by) - 1).cast("long").alias("turn"), F.lag("place", 1, 0).over(by).alias("after"), "place", "post_id")


#: Columns that a timeline lacks without comments or votes.
_ABSENT = {"local_post_id": "int", "value": "int", "previous_value": "int", "target_type": "string", "target_id": "long", "target_local_id": "int"}


def turn_segments(entries: DataFrame) -> DataFrame:
    """Entries with is_self (the viewer's own post), turn (own posts before the entry) and turns (own posts in all).

    What stands between two own posts belongs to the turn of the later one; what follows the last own post has
    turn = turns and belongs to none.
    """
    view = Window.partitionBy("session_id", "viewer")
    order = view.orderBy(*_ORDER)
    own = (F.col("kind") == "post") & (F.col("author") == F.col("viewer")) & (F.col("author_role") == "actor")
    marked = entries.withColumn("is_self", own)
    before = F.coalesce(F.sum(F.col("is_self").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("turn", before).withColumn("turns", F.sum(F.col("is_self").cast("int")).over(view)).withColumn("place", F.row_number().over(order))


def uses_vote_language(content: Column, pattern: str) -> Column:
    return F.coalesce(content.rlike(pattern), F.lit(False))


def votes_if_mentioned(votes: DataFrame, posts: DataFrame, comments: DataFrame | None, pattern: str) -> DataFrame:
    """The votes of those views in which an actor's post, or comment where comments count, speaks of voting. Without viewers, as
    where all see the same, a view is a session."""
    view = ["session_id", "viewer"] if "viewer" in votes.columns else ["session_id"]
    said = posts.filter("author_role = 'actor'").select(*view, "content")
    if comments is not None:
        said = said.union(comments.filter("author_role = 'actor'").select(*view, "content"))
    views = said.groupBy(*view).agg(F.bool_or(uses_vote_language(F.col("content"), pattern)).alias("_said"))
    return votes.join(views.filter("_said").drop("_said"), view, "left_semi")


def anonymous_voters(votes: DataFrame, sessions: DataFrame) -> DataFrame:
    """Votes with a drawn wording in place of each judge's name."""
    titled = votes.join(sessions.select("session_id", F.col("title").alias("_title")), "session_id")
    drawn = pick("anonymous_voter", F.col("_title"), F.concat(F.lit("V"), F.col("vote_id").cast("string")))
    return titled.withColumn("voter_name", F.when(F.col("voter_role") == "judge", drawn).otherwise(F.col("voter_name"))).drop("_title")


def with_running_scores(entries: DataFrame) -> DataFrame:
    """Vote entries with cur_score, the target's sum over the votes that the viewer has been shown; own votes go."""
    shown = entries.filter(~((F.col("kind") == "vote") & (F.col("author") == F.col("viewer"))))
    upto = Window.partitionBy("session_id", "viewer", "target_type", "target_id").orderBy("created_at", "order_id", "author").rowsBetween(Window.unboundedPreceding, 0)
    return shown.withColumn("cur_score", F.when(F.col("kind") == "vote", F.sum("value").over(upto)))


def wordings(entries: DataFrame, seed: Column, shown_author: Column, content: Column, votes: bool) -> DataFrame:
    """Entries with _text as others see them and _own_text as their author does, their wording drawn by the session's seed and the entry.
    A vote's text has {cur} for the sum that its viewer sees. Without votes their part is left out, which keeps the generated code small."""
    entry = F.concat(F.upper(F.substring("kind", 1, 1)), F.col("entry_id").cast("string"))
    header = F.when(F.col("kind") == "post", pick("post_header", seed, entry)).otherwise(pick("comment_header", seed, entry))
    header = _fill(header, local_id=F.col("local_id"), local_post_id=F.col("local_post_id"), author=shown_author)
    body = F.concat(F.lit("\n"), strip(content), F.lit("\n"))
    said = lambda you: F.concat(_fill(header, is_you=you), body)
    text, own = said(F.lit("")), said(pick("you_marker", seed, entry))
    if votes:
        target = F.concat(F.when(F.col("target_type") == "post", "P_").otherwise("C_"), F.col("target_local_id").cast("string"))
        value = score_text(F.col("value"))
        change = F.when(F.col("previous_value").isNotNull(), _fill(pick("vote_change_text", seed, entry), prev=score_text(F.col("previous_value")), value=value)).otherwise(_fill(pick("vote_new_text", seed, entry), value=value))
        vote = F.concat(_fill(pick("vote_event", seed, entry), author=shown_author, target=target, change=change), F.lit("\n"))
        text, own = F.when(F.col("kind") == "vote", vote).otherwise(text), F.when(F.col("kind") == "vote", vote).otherwise(own)
    return entries.withColumn("_text", text).withColumn("_own_text", own)


def _fill(template: Column, **fields: Column) -> Column:
    """The template with {name} replaced; a field's text is never searched again for an earlier name."""
    for name, value in fields.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def trajectories(entries: DataFrame, sessions: DataFrame, rewards: DataFrame, names: DataFrame | None = None, coupled: bool = True, least_chars: int = LEAST_CHARS) -> tuple[DataFrame, DataFrame]:
    """(samples, dropped) from a timeline: one sample for each viewer with own posts of which one is long enough.

    entries are those of session_entries, which each actor of the session sees, or a timeline with a viewer. sessions has session_id and
    title, rewards post_id, reward and advantage, and session_id if it is to be joined where the rows lie, names (session_id, name, alias). dropped
    counts the viewers without any turn (zero_turns) and those whose turns are all short (all_short).
    """
    shared, votes = "viewer" not in entries.columns, "value" in entries.columns
    entries = entries.withColumns({c: F.lit(None).cast(kind) for c, kind in _ABSENT.items() if c not in entries.columns})
    heads = sessions.select("session_id", F.col("title").alias("_title"))  # what a session's entries and turns share
    if names is not None:
        maps = names.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "alias"))).alias("_names"))
        heads = heads.join(maps, "session_id", "left")
        known = F.col("_names")
        alias = lambda c: F.coalesce(F.when(known.isNotNull(), F.try_element_at(known, c)), c)
        entries = entries.join(heads, "session_id").withColumn("content", substitute_names(F.col("content"), known))
        heads = heads.withColumn("_shown_title", substitute_names(F.col("_title"), known))
    else:
        alias = lambda c: c
        entries = entries.join(heads, "session_id")
        heads = heads.withColumn("_shown_title", F.col("_title"))
    seed = F.col("_title")
    entries = wordings(entries, seed, alias(F.col("author")), F.col("content"), votes)
    posted = (F.col("kind") == "post") & (F.col("author_role") == "actor")
    entries = entries.withColumn("content", F.when(posted, strip(F.col("content")))).withColumn("_own_text", F.when(~posted, F.col("_own_text")))
    if shared:
        return _samples_of(_shared_samples(entries, heads, rewards, alias, votes, coupled, least_chars))
    keys = [c for c in ("session_id",) if c in rewards.columns]
    given = rewards.select(*keys, F.lit("post").alias("kind"), F.col("post_id").alias("entry_id"), "reward", "advantage")
    entries = entries.join(given, [*keys, "kind", "entry_id"], "left")
    needed = ["session_id", "viewer", *_ORDER, "place", "kind", "author_role", "value", "target_type", "target_id", "content", "_text", "_own_text", "reward", "advantage"]
    entries = entries.select(*(c for c in needed if c in entries.columns))
    seg = turn_segments(with_running_scores(entries) if votes else entries)
    if not coupled:
        seg = seg.filter("is_self or kind <> 'post'")
    text = F.when(F.col("author") == F.col("viewer"), F.col("_own_text")).otherwise(F.col("_text"))
    if votes:
        text = F.when(F.col("kind") == "vote", _fill(F.col("_text"), cur=score_text(F.col("cur_score")))).otherwise(text)
    live = seg.filter(F.col("turn") < F.col("turns")).withColumn("_shown", F.when(~F.col("is_self"), text))
    # keyed by session and viewer, so that the rows stay where they lie
    turn = live.groupBy("session_id", "viewer", "turn").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("is_self"), F.struct("place", "_shown")))), lambda x: x["_shown"]), "\n").alias("updates"),
        F.max(F.when(F.col("is_self"), F.struct(F.col("entry_id").alias("post_id"), "content", "reward", "advantage"))).alias("own"),
    )
    turn = turn.join(heads, "session_id").select("session_id", "viewer", "_title", "_shown_title", alias(F.col("viewer")).alias("_alias"), "turn", strip(F.col("updates")).alias("updates"), "own.*")
    turn = turn.withColumns(_frames(seed))
    turn = turn.withColumn("asked", _asked(F.col("turn") == 0, F.col("updates"))).withColumn("trainable", F.length("content") >= least_chars)
    listed = F.sort_array(F.collect_list(F.struct("turn", "asked", "content", "reward", F.round("advantage", 4).alias("advantage"), "post_id", "trainable"))).alias("x")
    gathered = turn.groupBy("session_id", "viewer").agg(F.first("_alias").alias("_alias"), listed)
    samples, dropped = _samples_of(gathered.withColumn("usable", F.exists("x.trainable", lambda x: x)))
    views = seg.groupBy("session_id", "viewer").agg(F.max("turns").alias("turns"))
    return samples, views.agg(F.count_if(F.col("turns") == 0).alias("zero_turns")).crossJoin(dropped.select("all_short"))  # one row each


def _frames(seed: Column) -> dict[str, Column]:
    """What stands around a turn's updates, drawn by the session's seed."""
    drawn = {k: pick(k, seed) for k in ("prompt_intro", "section_problem", "section_discussion", "section_next", "no_new_content")}
    return {f"_{k}": c for k, c in drawn.items()}


def _asked(first: Column, updates: Column) -> Column:
    """What a turn is asked, from the columns of _frames, _alias and _shown_title."""
    begin = F.concat_ws(
        "\n", _fill(F.col("_prompt_intro"), name=F.col("_alias")), F.lit(""), F.col("_section_problem"), F.lit(""), strip(F.col("_shown_title")), F.lit(""),
        F.when(updates != "", F.concat(F.col("_section_discussion"), F.lit("\n\n"), updates, F.lit("\n"))), F.col("_section_next"),
    )
    later = F.concat(F.when(updates == "", F.col("_no_new_content")).otherwise(updates), F.lit("\n\n"), F.col("_section_next"))
    return F.when(first, begin).otherwise(later)


def _shared_samples(entries: DataFrame, heads: DataFrame, rewards: DataFrame, alias, votes: bool, coupled: bool, least_chars: int) -> DataFrame:
    """(session_id, viewer, _alias, x) of worded session entries: a viewer's turns are cut out of its session's texts, of which there is one list for all viewers.

    Only where a viewer's text differs is there an entry of its own, found by windows where the session's rows lie: its own comments, its own votes, which go,
    and votes of others on targets on which it votes as well, as their sums leave its own votes out. A sample holds its session's texts in any case, so no row is wider than the result's.
    """
    posted = (F.col("kind") == "post") & (F.col("author_role") == "actor")
    vote, nobody = F.col("kind") == "vote", F.lit(None).cast("string")
    target = ["session_id", "target_type", "target_id"]
    sees = F.max(posted.cast("int")).over(Window.partitionBy("session_id", "author")) == 1
    rows = entries.select("session_id", "place", "kind", "author", "author_role", "entry_id", "content", "value", "target_type", "target_id", "_text", "_own_text").withColumn("_sees", sees)
    differ = F.when(F.col("_sees") & ~vote & ~posted, F.array("author")).otherwise(F.array().cast("array<string>"))
    if votes:
        rows = rows.withColumn("_voters", F.collect_set(F.when(vote & F.col("_sees"), F.col("author"))).over(Window.partitionBy(*target)))
        differ = F.when(vote, F.col("_voters")).otherwise(differ)
    rows = rows.withColumn("_for", F.explode(F.concat(F.array(nobody), differ)))
    shared = F.col("_for").isNull()
    text = F.when(shared, F.col("_text")).otherwise(F.col("_own_text"))
    if votes:
        upto = Window.partitionBy(*target, "_for").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        others = F.when(vote & F.col("author").isNotNull() & (shared | (F.col("author") != F.col("_for"))), F.col("value").cast("long"))
        rows = rows.withColumn("_cur", F.sum(others).over(upto))
        own_vote = F.col("author").isNull() | F.coalesce(F.col("author") == F.col("_for"), F.lit(False))
        text = F.when(vote, F.when(~own_vote, _fill(F.col("_text"), cur=score_text(F.col("_cur"))))).otherwise(text)
    if not coupled:
        text = F.when(F.col("kind") != "post", text)
    rows = rows.withColumn("_said", text)
    listed = lambda when, *c: F.sort_array(F.collect_list(F.when(when, F.struct(*c))))
    viewer = F.col("author").alias("viewer")
    told = rows.groupBy("session_id").agg(
        listed(shared, "place", "_said").alias("_texts"), listed(~shared, F.col("_for").alias("viewer"), "place", "_said").alias("_others"),
        listed(shared & posted & F.col("author").isNotNull(), viewer, "place", F.col("entry_id").alias("post_id"), "content").alias("_posts"),
    )
    if "session_id" not in rewards.columns:
        rewards = rewards.join(entries.filter("kind = 'post'").select("session_id", F.col("entry_id").alias("post_id")), "post_id")
    given = rewards.groupBy("session_id", "post_id").agg(F.first(F.struct("reward", "advantage")).alias("r")).groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("post_id", "r"))).alias("_given"))
    told = told.filter(F.size("_posts") > 0).withColumn("_texts", F.col("_texts._said")).join(heads.withColumns(_frames(F.col("_title"))), "session_id").join(given, "session_id", "left")
    seen = told.withColumn("viewer", F.explode(F.array_distinct(F.col("_posts.viewer")))).withColumn("_alias", alias(F.col("viewer")))
    seen = seen.withColumn("_mine", F.filter("_posts", lambda o: o["viewer"] == F.col("viewer"))).withColumn("_differ", F.filter("_others", lambda o: o["viewer"] == F.col("viewer")))
    before = lambda c, k: F.coalesce(F.get(F.col(c), k - 1)["place"], F.lit(0))
    seen = seen.select(*(c for c in seen.columns if c not in ("_mine", "_differ", "_posts", "_others")), F.transform("_mine", lambda o, k: F.struct(before("_mine", k).alias("after"), o["place"].alias("place"), o["post_id"].alias("post_id"), o["content"].alias("content"))).alias("_mine"),
        F.transform("_differ", lambda o, k: F.struct(before("_differ", k).alias("after"), o["place"].alias("place"), o["_said"].alias("said"))).alias("_differ"))

    def between(after: Column, place: Column) -> Column:
        return F.slice("_texts", after + 1, place - after - 1)

    def updates(after: Column, place: Column) -> Column:
        inside = F.filter("_differ", lambda d: (d["place"] > after) & (d["place"] < place))
        upto = F.flatten(F.transform(inside, lambda d: F.concat(between(F.greatest(after, d["after"]), d["place"]), F.array(d["said"]))))
        last = F.coalesce(F.get(F.reverse(inside), F.lit(0))["place"], after)
        return strip(F.array_join(F.concat(upto, between(last, place)), "\n"))

    reward = lambda o: F.try_element_at("_given", o["post_id"])
    turns = F.transform("_mine", lambda o: F.struct(o.alias("o"), updates(o["after"], o["place"]).alias("updates"), reward(o).alias("r")))
    turn = lambda u, k: F.struct(
        _asked(k == 0, u["updates"]).alias("asked"), u["o"]["content"].alias("content"), u["r"]["reward"].alias("reward"), F.round(u["r"]["advantage"], 4).alias("advantage"),
        u["o"]["post_id"].alias("post_id"), (F.length(u["o"]["content"]) >= least_chars).alias("trainable"),
    )
    # told by the posts alone, so that a filter needn't work the turns out
    usable = F.exists("_mine", lambda o: F.length(o["content"]) >= least_chars).alias("usable")
    return seen.withColumn("_turns", turns).select("session_id", "viewer", "_alias", usable, F.transform("_turns", turn).alias("x"))


def _samples_of(gathered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, dropped) of viewers (session_id, _alias, usable, x), x being the turns in order."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    samples = gathered.select(
        F.flatten(F.transform("x", lambda x: F.array(message("user", x["asked"]), message("assistant", x["content"])))).alias("messages"),
        F.col("x.reward").alias("turn_rewards"), F.col("x.advantage").alias("turn_advantages"), F.col("x.post_id").alias("turn_post_ids"),
        F.col("x.trainable").alias("turn_trainable"), F.col("session_id").cast("string").alias("session_id"), F.col("_alias").alias("actor"), "usable",
    )
    return samples.filter("usable").drop("usable"), samples.agg(F.lit(0).cast("long").alias("zero_turns"), F.count_if(~F.col("usable")).alias("all_short"))


def enough_samples(samples: DataFrame, least: int) -> DataFrame:
    """The samples of sessions that have at least so many of them."""
    n = F.count("*").over(Window.partitionBy("session_id"))
    return samples.withColumn("_n", n).filter(F.col("_n") >= least).drop("_n")
