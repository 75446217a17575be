"""Readers for tables, question pools, sample files, run folders and layered settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import GOLD_LETTER, strip

#: One training sample of a participant; all turn_ arrays have one entry for each assistant message.
TRAJECTORY = T.StructType(
    [
        T.StructField("messages", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))),
        T.StructField("turn_rewards", T.ArrayType(T.DoubleType())),
        T.StructField("turn_advantages", T.ArrayType(T.DoubleType())),
        T.StructField("turn_post_ids", T.ArrayType(T.LongType())),
        T.StructField("turn_trainable", T.ArrayType(T.BooleanType())),
        T.StructField("session_id", T.StringType()),
        T.StructField("actor", T.StringType()),
    ]
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc_table(spark: SparkSession, url: str, name: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1) -> DataFrame:
    """A database table, read in parts by ranges of an integer key; needs the database's JDBC driver on the class path."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    if key and parts > 1:
        reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def question_pool(spark: SparkSession, paths: list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lists of questions, one after the other: `pool` is the file's place in paths. Ids are left to the caller."""
    frames = []
    for k, path in enumerate(paths):
        reader = spark.read.option("multiLine", True)
        frames.append((reader.schema(schema) if schema else reader).json(path).withColumn("pool", F.lit(k)))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str = TRAJECTORY) -> DataFrame:
    return spark.read.schema(schema).json(path)


def csv_questions(spark: SparkSession, path: str) -> DataFrame:
    """Multiple-choice questions from CSV with a header; quoted fields may span lines."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def question_sessions(pool: DataFrame, limit: int = 0) -> DataFrame:
    """Sessions from questions: title, description and reference_solution with their fallbacks; rows without a title go.

    The limit counts rows before those without title go, as `n_read` of the source does; 0 takes all.
    """
    text = lambda c: F.nullif(F.col(c), F.lit("")) if c in pool.columns else F.lit(None).cast("string")
    solution, answer = F.coalesce(text("reference_solution"), text("solution"), F.lit("")), text("answer")
    reference = F.when(answer.isNotNull(), strip(F.concat(solution, F.lit("\n\nFinal answer: "), answer))).otherwise(solution)
    rows = pool.limit(limit) if limit else pool
    out = rows.select(F.coalesce(text("title"), text("problem")).alias("title"), F.coalesce(text("description"), F.lit("")).alias("description"), reference.alias("reference_solution"))
    return out.filter(F.col("title").isNotNull())


def choice_rows(pool: DataFrame, pattern: str = GOLD_LETTER) -> DataFrame:
    """Questions with a gold letter: that of the row, else the one that the pattern finds first in its answer, in upper case as it stands; others go."""
    found = F.nullif(F.regexp_extract(F.coalesce("answer", F.lit("")), pattern, 1), F.lit(""))
    own = F.nullif(F.col("gold_letter"), F.lit("")) if "gold_letter" in pool.columns else F.lit(None).cast("string")
    return pool.withColumn("gold_letter", F.coalesce(own, found)).filter("gold_letter is not null")


def title_index(pool: DataFrame, order_col: str) -> DataFrame:
    """One row for each title, the last by order_col, and `mode`: letter if any row has a gold letter, else boxed. The title is the problem where the
    row has one, else its title; rows without either go."""
    text = lambda c: F.nullif(F.col(c), F.lit("")) if c in pool.columns else F.lit(None).cast("string")
    pool = pool.withColumn("title", F.coalesce(text("problem"), text("title")))
    columns = [c for c in pool.columns if c != "title"]
    last = pool.filter("title is not null").groupBy("title").agg(F.max_by(F.struct(*columns), F.col(order_col)).alias("row"))
    mode = pool.agg(F.when(F.coalesce(F.bool_or(F.coalesce("gold_letter", F.lit("")) != ""), F.lit(False)), "letter").otherwise("boxed").alias("mode"))
    return last.select("title", "row.*").crossJoin(F.broadcast(mode))  # one row


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, value) of `key: value` text files: the first colon splits, the last line of a key wins."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = raw.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("at", "line")).filter(F.col("line").contains(":"))
    pair = F.split("line", ":", 2)
    lines = lines.select("path", "at", strip(pair[0]).alias("key"), strip(pair[1]).alias("value"))
    return lines.groupBy("path", "key").agg(F.max_by("value", "at").alias("value"))


def layered(shared: dict, own: dict) -> dict:
    """Settings with a layer of their own above the shared one."""
    return {**shared, **own}


def run_folders(spark: SparkSession, folder: str) -> DataFrame:
    """(run, manifest, state): the direct child folders that hold manifest.json or state.json, with their text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(f"{folder}/*/")
    name = F.regexp_extract("path", r"([^/]+)/([^/]+)$", 2)
    files = files.select(F.regexp_extract("path", r"([^/]+)/([^/]+)$", 1).alias("run"), name.alias("file"), F.col("content").cast("string").alias("text"))
    files = files.filter(F.col("file").isin("manifest.json", "state.json"))
    pick = lambda f: F.max(F.when(F.col("file") == f, F.col("text")))
    return files.groupBy("run").agg(pick("manifest.json").alias("manifest"), pick("state.json").alias("state"))


def newest_by_prefix(entries: DataFrame, prefix: str) -> DataFrame:
    """Of entries (path, modified), the newest whose name starts with the prefix; ties go to the larger path."""
    named = entries.filter(F.regexp_extract("path", r"([^/]+)/?$", 1).startswith(prefix))
    return named.agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def latest_step(entries: DataFrame) -> DataFrame:
    """The highest N of entries (path) named step_N; null without any."""
    return entries.agg(F.max(F.try_to_number(F.nullif(F.regexp_extract("path", r"(?:^|/)step_(\d+)/?$", 1), F.lit("")), F.lit("999999999")).cast("int")).alias("step"))


def complete_samples(lines: DataFrame) -> DataFrame:
    """Whether each file of lines (path, at, line) is a complete sample file: 100 bytes or more, its first and last lines
    objects with messages and turn_advantages."""
    # a line that is no JSON object parses to nulls
    parsed = lambda c: F.from_json(c, "messages array<string>, turn_advantages array<string>")
    ok = lambda c: F.coalesce(parsed(c)["messages"].isNotNull() & parsed(c)["turn_advantages"].isNotNull(), F.lit(False))
    full = lines.filter(F.length(F.trim("line")) > 0)
    out = full.groupBy("path").agg(F.sum(F.octet_length("line") + 1).alias("bytes"), F.min_by("line", "at").alias("first"), F.max_by("line", "at").alias("last"))
    return out.select("path", ((F.col("bytes") >= 100) & ok("first") & ok("last")).alias("complete"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, line) of text files; at is the line's number."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return raw.select("path", F.posexplode(F.split("value", "\n")).alias("at", "line"))


def with_order(df: DataFrame, name: str, *order) -> DataFrame:
    """df with a gapless number from 0 in the given order; for tables of settings size, since one task numbers them."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)
