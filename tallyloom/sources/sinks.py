"""Writers for samples, shards, reports and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(samples: DataFrame, path: str, order: list[str] | None = None, one_file: bool = False) -> None:
    """Samples as UTF-8 JSON lines; ordered within and between files if asked, in one file only for byte parity."""
    out = samples.orderBy(*order) if order else samples
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_shards(schedule: DataFrame, path: str) -> None:
    """A schedule (epoch, round, ...) as one folder for each epoch and round."""
    schedule.repartition("epoch", "round").write.mode("overwrite").partitionBy("epoch", "round").json(path)


def append(rows: DataFrame, path: str) -> None:
    """Rows added to an append-only table."""
    rows.write.mode("append").parquet(path)


def _creator(*needed: str):
    """A writer of new rows; rows without one of the needed columns' values are refused as a whole."""

    def create(rows: DataFrame, path: str) -> None:
        lacking = [c for c in needed if c not in rows.columns]
        if lacking:
            raise ValueError(f"columns are lacking: {', '.join(lacking)}")
        whole = rows
        for c in needed:
            whole = whole.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is null"))))
        append(whole, path)

    return create


create_users = _creator("user_id", "name", "role")
create_sessions = _creator("session_id", "title")
create_posts = _creator("post_id", "session_id", "user_id", "content")
create_comments = _creator("comment_id", "post_id", "user_id", "content")
log_requests = _creator()


def write_run_files(files: DataFrame, folder: str) -> None:
    """The small text files (path below folder, text) of run folders, written by the tasks that hold the rows; a file that is there is replaced. folder is one that all
    executors reach."""

    def write(rows) -> None:
        from pyarrow import fs

        files_, top = fs.FileSystem.from_uri(folder)
        for r in rows:
            target = f"{top}/{r.path}"
            files_.create_dir(target.rpartition("/")[0], recursive=True)
            with files_.open_output_stream(target) as out:
                out.write(r.text.encode())

    files.foreachPartition(write)


def failed_requests(log: DataFrame) -> DataFrame:
    """The log rows worth keeping of a request log: errors on session paths, /me or /users."""
    endpoint = F.col("endpoint")
    return log.filter((F.col("response_code") >= 400) & (endpoint.startswith("/sessions/") | endpoint.isin("/me", "/users")))


def missing_users(users: DataFrame, actors: int, judges: int) -> DataFrame:
    """(name, role) of the numbered seed participants that users doesn't hold yet."""
    spark = users.sparkSession
    wanted = spark.range(1, actors + 1).select(F.concat(F.lit("Scientist_"), "id").alias("name"), F.lit("actor").alias("role"))
    wanted = wanted.union(spark.range(1, judges + 1).select(F.concat(F.lit("Judge_"), "id"), F.lit("judge")))
    return wanted.join(users.select("name"), "name", "left_anti")


def report(records: DataFrame, by: str, ok: str = "correct") -> DataFrame:
    """One row for a report file: totals, accuracy, and accuracy for each value of by as a map."""
    groups = records.groupBy(by).agg(F.avg(F.col(ok).cast("int")).alias("accuracy"), F.count("*").alias("n"), F.sum(F.col(ok).cast("int")).alias("right"))
    parts = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce(F.col(by).cast("string"), F.lit("")), "accuracy"))))
    return groups.agg(F.sum("n").alias("n"), F.coalesce(F.try_divide(F.sum("right"), F.sum("n")), F.lit(0.0)).alias("accuracy"), parts.alias("per_category"))
