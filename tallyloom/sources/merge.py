"""A stored table of current votes, updated by copy on write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.running import running_sums
from .scratch import written

_KEY = ["voter", "target_type", "target_id"]


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def upsert_votes(votes: DataFrame, path: str, buckets: int = 64) -> DataFrame:
    """Merge votes (voter, target_type, target_id, value, vote_id) into the table at path, and return those that count with previous_value, the voter's
    vote on the target before, and new_score, the target's total after the vote.

    The table has one row for each voter and target, with the value that it replaced, in folders by a hash of the target; its number is that of the
    first call. Only folders that the votes fall into are read and written anew; the others' files stay as they are. Votes that aren't newer by vote_id than the
    stored one of their key are passed over, so the same votes again change nothing, also after a run that ended while it wrote.
    """
    spark = votes.sparkSession
    bucket = F.pmod(F.xxhash64("target_type", "target_id"), F.lit(buckets)).cast("int")
    cast = votes.select(*_KEY, F.col("value").cast("long").alias("value"), F.col("vote_id").cast("long").alias("vote_id")).withColumn("bucket", bucket)
    columns = [*_KEY, "value", "previous_value", "vote_id", "bucket"]
    stored = cast.withColumn("previous_value", F.lit(None).cast("long")).select(*columns).limit(0)
    if _exists(spark, path):
        touched = [r.bucket for r in cast.select("bucket").distinct().collect()]  # as many as there are folders at most
        stored = spark.read.schema(stored.schema).parquet(path).filter(F.col("bucket").isin(touched)).select(*columns)
    held = stored.select(*_KEY, F.col("value").alias("_old"), F.col("vote_id").alias("_seen"))
    fresh = cast.join(held, _KEY, "left").filter(F.col("_seen").isNull() | (F.col("vote_id") > F.col("_seen")))
    by_key = Window.partitionBy(*_KEY).orderBy("vote_id")
    fresh = fresh.withColumn("previous_value", F.coalesce(F.lag("value").over(by_key), F.col("_old"))).withColumn("_last", F.lead("vote_id").over(by_key).isNull())
    fresh = fresh.withColumn("_change", F.col("value") - F.coalesce("previous_value", F.lit(0))).drop("_old", "_seen")
    totals = stored.groupBy("target_type", "target_id").agg(F.sum("value").alias("_base"))
    scored = running_sums(fresh, ["target_type", "target_id"], ["vote_id", "voter"], "_change", "_sum").join(totals, ["target_type", "target_id"], "left")
    scored = written(scored.withColumn("new_score", F.coalesce("_base", F.lit(0)) + F.col("_sum")), "votes")
    last = scored.filter("_last").select(*columns)
    merged = written(stored.join(last.select(*_KEY), _KEY, "left_anti").unionByName(last), "merged")
    # folders are replaced as a whole when all tasks have ended; a folder with very many rows is split over tasks
    merged.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return scored.select(*_KEY, "vote_id", "value", "previous_value", "new_score")
