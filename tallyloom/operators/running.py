"""Places and running sums over groups of any size: rows are dealt into ranges, so no task holds a group as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import in_range_parts


def numbered(rows: DataFrame, order: list, name: str = "place") -> DataFrame:
    """rows with their place from 0 in the order of all rows."""
    ranged = in_range_parts(rows, order, "numbered")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + F.col("_before")
    return ranged.join(F.broadcast(before), "_part").withColumn(name, place).drop("_part", "_before")


def running_sums(rows: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with the sum of value over their group up to and with themselves; group and order name columns that tell rows apart.

    A range of rows sums its own part of each group. Only groups that lie in several ranges need what lies before: at most two of them meet at each border of
    ranges, so the sums that are handed on are few, however many groups and rows there are.
    """
    ranged = in_range_parts(rows, [*group, *order], "running")
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = ranged.groupBy("_part", *group).agg(F.sum(value).alias("_sum"))
    edges = parts.groupBy("_part").agg(F.min(F.struct(*group)).alias("first"), F.max(F.struct(*group)).alias("last"))
    shared = edges.select(F.explode(F.array("first", "last")).alias("g")).groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g.*")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in group]
    of_shared = parts.alias("p").join(F.broadcast(shared.alias("s")), same, "left_semi")  # two rows a range at most
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = of_shared.select(*group, "_part", F.sum("_sum").over(earlier).alias("_before"))
    joined = ranged.withColumn("_inside", F.sum(value).over(inside)).alias("r").join(F.broadcast(before.alias("b")), [F.col("r._part") == F.col("b._part"), *(F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group)], "left")
    return joined.select(*(F.col(f"r.{c}").alias(c) for c in rows.columns), (F.col("_inside") + F.coalesce("_before", F.lit(0))).alias(name))
