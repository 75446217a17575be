"""Forum-shaped views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators import votes as V
from ..sources.readers import table


class Forum:
    """Sessions are groups of ten customers, posts are orders, votes are line items, comments and activity are events."""

    def __init__(self, spark: SparkSession, folder: str, streaming: bool = False):
        self.spark, self.folder, self.streaming = spark, folder, streaming

    def table(self, name: str) -> DataFrame:
        batch = table(self.spark, self.folder, name)
        if not self.streaming:
            return batch
        # a pattern that fits one name: the stream reader takes a plain path for a folder, and the table may be a file
        return self.spark.readStream.schema(batch.schema).parquet(f"{self.folder}/{name}.parque[t]")

    @property
    def posts(self) -> DataFrame:
        o = self.table("orders")
        text = F.concat("o_orderpriority", F.lit(" with status "), "o_orderstatus", F.lit(", scored by P_"), (F.col("o_orderkey") % 5).cast("string"))
        content = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderpriority")).otherwise(text)
        return o.select(
            F.col("o_orderkey").alias("post_id"), F.expr("o_custkey div 10").alias("session_id"), F.col("o_custkey").alias("user_id"),
            F.concat(F.lit("user_"), F.col("o_custkey").cast("string")).alias("author"), F.lit("actor").alias("author_role"), content.alias("content"), F.col("o_orderdate").alias("created_at"),
        )

    @property
    def sessions(self) -> DataFrame:
        """One more session than there are groups of customers: the last has no posts."""
        c = self.table("customer").select(F.expr("c_custkey div 10").alias("session_id"))
        ids = c.union(c.agg(F.max("session_id") + 1)).distinct()
        return ids.select("session_id", F.concat(F.lit("Problem "), F.col("session_id").cast("string")).alias("title"))

    @property
    def users(self) -> DataFrame:
        c = self.table("customer")
        return c.select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("user_"), F.col("c_custkey").cast("string")).alias("name"), F.when(F.col("c_custkey") % 10 == 0, "judge").otherwise("actor").alias("role"), F.md5(F.col("c_name").cast("binary")).alias("api_key"))

    @property
    def comments(self) -> DataFrame:
        e = self.table("events")
        return e.select(
            F.col("event_id").alias("comment_id"), F.expr("event_id div 3").alias("post_id"), "user_id", F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("author"),
            F.lit("actor").alias("author_role"), F.concat_ws(" ", "event_type", "props").alias("content"), F.col("ts").alias("created_at"),
        )

    @property
    def vote_events(self) -> DataFrame:
        """All votes as cast, zeros and values out of range too. vote_id orders a voter's votes on a target."""
        li = self.table("lineitem")
        days = F.unix_date(F.to_date("l_shipdate")).cast("long")
        vote_id = ((days * 8 + F.col("l_linenumber")) * 64 + F.col("l_quantity").cast("long")) * (1 << 33) + F.col("l_partkey")
        return li.select(
            vote_id.alias("vote_id"), F.col("l_suppkey").alias("voter"), F.when(F.col("l_suppkey") % 2 == 0, "judge").otherwise("actor").alias("voter_role"),
            F.concat(F.lit("user_"), F.col("l_suppkey").cast("string")).alias("voter_name"), F.when(F.col("l_linenumber") % 5 == 0, "comment").otherwise("post").alias("target_type"),
            F.col("l_orderkey").alias("target_id"), (F.col("l_quantity").cast("int") % 7 - 3).alias("value"), F.col("l_shipdate").alias("created_at"),
        )

    @property
    def votes(self) -> DataFrame:
        """Votes that count: no zeros, actors' values cut to one."""
        v = self.vote_events.filter("value <> 0")
        return v.withColumn("value", F.when(F.col("voter_role") == "actor", F.signum("value").cast("int")).otherwise(F.col("value")))

    @property
    def current_votes(self) -> DataFrame:
        return V.current_values(self.votes)

    @property
    def session_votes(self) -> DataFrame:
        return R.votes_in_sessions(self.current_votes, self.posts, self.comments).filter("session_id is not null")

    @property
    def session_vote_changes(self) -> DataFrame:
        """Current votes with the values that they replaced."""
        return R.votes_in_sessions(V.latest_votes(self.votes), self.posts, self.comments).filter("session_id is not null")

    @property
    def aliases(self) -> DataFrame:
        """(session_id, name, alias): what a session's actors are called, by their own names and as texts speak of them."""
        known = self.posts.select("session_id", "user_id", F.col("author").alias("name")).distinct()
        alias = F.concat(F.lit("Member "), (F.col("user_id") % 10).cast("string")).alias("alias")
        spoken = F.concat(F.lit("Scientist_"), (F.col("user_id") % 10).cast("string")).alias("name")
        return known.select("session_id", "name", alias).union(known.select("session_id", spoken, alias))


#: The same views as SQL for DuckDB.
VIEWS = """
WITH posts AS (
  SELECT o_orderkey AS post_id, o_custkey // 10 AS session_id, o_custkey AS user_id, 'user_' || o_custkey AS author, 'actor' AS author_role,
    CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority ELSE o_orderpriority || ' with status ' || o_orderstatus || ', scored by P_' || (o_orderkey % 5) END AS content,
    o_orderdate AS created_at FROM orders
), sessions AS (
  SELECT session_id, 'Problem ' || session_id AS title FROM (SELECT DISTINCT c_custkey // 10 AS session_id FROM customer UNION SELECT max(c_custkey // 10) + 1 FROM customer)
), users AS (
  SELECT c_custkey AS user_id, 'user_' || c_custkey AS name, CASE WHEN c_custkey % 10 = 0 THEN 'judge' ELSE 'actor' END AS role, md5(c_name) AS api_key FROM customer
), comments AS (
  SELECT event_id AS comment_id, event_id // 3 AS post_id, user_id, 'user_' || user_id AS author, 'actor' AS author_role, concat_ws(' ', event_type, props) AS content, ts AS created_at FROM events
), vote_events AS (
  SELECT ((date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) * 8 + l_linenumber) * 64 + CAST(trunc(l_quantity) AS BIGINT)) * 8589934592 + l_partkey AS vote_id,
    l_suppkey AS voter, CASE WHEN l_suppkey % 2 = 0 THEN 'judge' ELSE 'actor' END AS voter_role, 'user_' || l_suppkey AS voter_name,
    CASE WHEN l_linenumber % 5 = 0 THEN 'comment' ELSE 'post' END AS target_type, l_orderkey AS target_id, CAST(trunc(l_quantity) AS INT) % 7 - 3 AS value, l_shipdate AS created_at FROM lineitem
), votes AS (
  SELECT * REPLACE (CASE WHEN voter_role = 'actor' THEN CAST(sign(value) AS INT) ELSE value END AS value) FROM vote_events WHERE value <> 0
), history AS (
  SELECT *, lag(value) OVER w AS previous_value, lead(vote_id) OVER w IS NULL AS is_latest FROM votes WINDOW w AS (PARTITION BY voter, target_type, target_id ORDER BY vote_id)
), latest AS (
  SELECT * EXCLUDE (is_latest) FROM history WHERE is_latest
), placed AS (
  SELECT v.*, coalesce(p.session_id, q.session_id) AS session_id FROM latest v
  LEFT JOIN posts p ON v.target_type = 'post' AND p.post_id = v.target_id
  LEFT JOIN comments c ON v.target_type = 'comment' AND c.comment_id = v.target_id
  LEFT JOIN posts q ON q.post_id = c.post_id
), session_votes AS (
  SELECT * FROM placed WHERE session_id IS NOT NULL
), rewarded AS (
  SELECT p.*, CAST(coalesce(v.s, 0) AS DOUBLE) AS reward, count(*) OVER (PARTITION BY p.session_id) AS n_posts,
    (row_number() OVER (PARTITION BY p.session_id ORDER BY p.post_id) - 1) / greatest(count(*) OVER (PARTITION BY p.session_id) - 1, 1) AS t
  FROM posts p LEFT JOIN (SELECT target_id, sum(value) AS s FROM latest WHERE voter_role = 'judge' AND target_type = 'post' GROUP BY 1) v ON v.target_id = p.post_id
), slope AS (
  SELECT CASE WHEN count(*) >= 4 AND regr_sxx(reward, t) >= 1e-9 THEN coalesce(regr_slope(reward, t), 0) ELSE 0 END AS b FROM rewarded WHERE n_posts >= 4
), debiased AS (
  SELECT r.*, CASE WHEN abs(b) < 0.01 THEN reward ELSE reward - b * (t - 0.5) END AS debiased FROM rewarded r, slope
), whole AS (
  SELECT avg(debiased) AS m, greatest(CASE WHEN count(*) <= 1 THEN 1 ELSE stddev_pop(debiased) END, 1) AS s FROM debiased
), advantaged AS (
  SELECT d.*, (debiased - avg(debiased) OVER w) / greatest(CASE WHEN count(*) OVER w <= 1 THEN 1 ELSE stddev_pop(debiased) OVER w END, 1) AS advantage
  FROM debiased d WINDOW w AS (PARTITION BY session_id)
), actors AS (
  SELECT DISTINCT session_id, author AS viewer FROM posts WHERE author_role = 'actor'
), placed_comments AS (
  SELECT c.*, p.session_id FROM comments c JOIN posts p USING (post_id)
), scores AS (
  SELECT target_type, target_id, CAST(sum(value) AS BIGINT) AS score FROM latest GROUP BY ALL
)
"""
