"""Tables written to the shared checkpoint folder, and running totals that never gather a group in one task."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import map_arrow
from ..sources.scratch import delete, scratch_root

#: The paths written inside each open temporary(), the innermost last.
_open: ContextVar[tuple[list, ...]] = ContextVar("open", default=())


@contextmanager
def temporary():
    """The tables that materialize() writes inside are deleted at the end, also after an error, but for those that are kept:
    they belong to the temporary() around this one, or stay until the application ends."""
    paths: list[tuple[SparkSession, str]] = []
    token = _open.set((*_open.get(), paths))
    try:
        yield
    finally:
        _open.reset(token)
        for spark, path in paths:
            delete(spark, path)


def tidy(operator):
    """operator inside temporary(): what it doesn't keep is deleted once its result is planned."""

    @wraps(operator)
    def run(*args, **named):
        with temporary():
            return operator(*args, **named)

    return run


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, survives lost executors, gives exact size statistics."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    around = _open.get()[: -1 if keep else None]
    if around:
        around[-1].append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallyloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote, once nothing reads it any more."""
    if path := getattr(df, "_tallyloom_path", None):
        delete(df.sparkSession, path)


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


def running_totals(df: DataFrame, group: str, order: list, sums: list[str], label: str, keep: bool = False) -> DataFrame:
    """df with `<s>_before` for each s of sums: the total of s over the rows of the same group that stand before this one.

    group names a column of integers without nulls; sums name long columns without nulls. The rows are range
    partitioned by (group, order), so a group that holds most rows is spread over many tasks; the partitions'
    totals (one row for each partition and group in it) are accumulated and joined back.
    """
    added = [f"{s}_before" for s in sums]
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), *(T.StructField(a, T.LongType()) for a in added)])

    def within(batches):
        part = TaskContext.get().partitionId()
        last, carry = None, np.zeros(len(sums), dtype=np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            g = batch.column(group).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1])
            lengths = np.diff(np.concatenate([starts, [n]]))
            new = []
            for k, s in enumerate(sums):
                v = batch.column(s).to_numpy(zero_copy_only=False).astype(np.int64)
                before = np.cumsum(v) - v
                base = before[starts]
                if last is not None and g[0] == last:
                    base[0] -= carry[k]
                out = before - np.repeat(base, lengths)
                carry[k] = out[-1] + v[-1]
                new.append(pa.array(out))
            last = g[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, dtype=np.int32)), *new], names=[*batch.schema.names, "_part", *added])

    ranged = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    rows = materialize(map_arrow(ranged, within, schema), label, keep)
    parts = rows.groupBy("_part", group).agg(*(F.sum(s).alias(f"_sum_{s}") for s in sums))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", group, *(F.coalesce(F.sum(f"_sum_{s}").over(earlier), F.lit(0)).alias(f"_off_{s}") for s in sums))
    # at most one row for each partition and group boundary, whatever the number of rows
    out = rows.join(F.broadcast(parts), ["_part", group])
    return out.select(*df.columns, *((F.col(a) + F.col(f"_off_{s}")).alias(a) for a, s in zip(added, sums, strict=True)))
