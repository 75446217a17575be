"""A folder for intermediate tables that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_roots: dict[str, str] = {}


def delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the context may be gone; the folder goes with the driver
        pass


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; a temporary folder only in local mode with that setting unset."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not shared:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            shared = f"file://{tempfile.mkdtemp(prefix='tallyloom-')}"
        _roots[app] = f"{shared.rstrip('/')}/tallyloom-{app}-{uuid.uuid4().hex[:8]}"
        target = spark._jvm.org.apache.hadoop.fs.Path(_roots[app])
        files = target.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(target)
        files.deleteOnExit(target)  # when the driver's JVM ends
    return _roots[app]


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the application's folder and read again, so that all who read it see the same rows in the same partitions."""
    path = f"{scratch_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_range_parts(df: DataFrame, order: list, label: str) -> DataFrame:
    """df dealt into ranges of the order, with `_part`, the number of a row's range: no task sorts all rows.

    The rows are written with their number: an exchange that is planned again may deal them otherwise.
    """
    return written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), label)
