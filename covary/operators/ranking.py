"""Numbering and running maxima over long groups, none of which is one task's work."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covary.sources.store import stored

#: Neighbouring numbers that one task takes the running maximum of.
CHUNK = 1 << 16


def ranked(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df with `name`: 1, 2, .. within each group in the given order (ascending; ties are numbered in any order). Rows
    are dealt by ranges of (group, order), so that a group of any size lies over as many tasks as it fills; a row's number
    is its place in its range and what the ranges before it hold of its group. The ranges are stored, as both steps must
    see the same ones."""
    ranges = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    placed = stored(ranges.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    held = placed.groupBy(*group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*group).orderBy("_range"))  # a row per range that holds some of the group
    held = held.withColumn("_before", upto - F.col("_n")).select(*group, "_range", "_first", "_before")
    return placed.join(held, [*group, "_range"]).withColumn(name, (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("int")).drop("_range", "_at", "_first", "_before")


def running_max(df: DataFrame, group: list[str], at: str, value: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """df with `name`: the largest `value` at smaller `at`s of the same group, null if there are none. `at` are whole
    numbers; each task sees a chunk of neighbouring ones, and what the chunks before it lead to."""
    rows = df.withColumn("_chunk", F.floor(F.col(at) / chunk))
    most = rows.groupBy(*group, "_chunk").agg(F.max(value).alias("_most"))
    before = F.max("_most").over(Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))  # a row per chunk
    most = most.withColumn("_before", before).select(*group, "_chunk", "_before")
    own = F.max(value).over(Window.partitionBy(*group, "_chunk").orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_own", own).join(most, [*group, "_chunk"]).withColumn(name, F.greatest("_own", "_before")).drop("_chunk", "_own", "_before")
