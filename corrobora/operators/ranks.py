"""Places of rows inside their groups, without a task that sees a whole group.

Rows are dealt by ranges of (group, order), so a group of any size lies in as
many partitions as it fills; equal rows are told apart by where they were read
and split as well. What a partition then needs is one number for each group in
it: how many of the group's rows lie in earlier partitions. That small table
has at most one row for each group and partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrobora.sources.shared import materialize

#: Rows of the small table up to which it is broadcast (some 60 bytes each).
MOST_STARTS = 50_000


def ordered(rows: DataFrame, group: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The rows in order, written, with ``part`` and ``at``; and starts (group, part, first, before, n), written. ``group`` has no nulls."""
    by = [F.col(group), *order, F.col("salt")]
    dealt = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("salt")
    placed = materialize(dealt.withColumn("at", F.monotonically_increasing_id()), "ordered").withColumn("part", F.shiftright("at", 33).cast("int"))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("rows")).select(
        group, "part", "first", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy(group)).alias("n"),
    )
    return placed, materialize(starts, "starts")


def numbered(placed: DataFrame, starts: DataFrame, group: str) -> DataFrame:
    """The rows with ``node``, their place from 0, and all further columns of ``starts``; joined by group and partition, so a hot group stays split."""
    small = F.broadcast(starts) if starts.count() <= MOST_STARTS else starts.hint("merge")
    return placed.join(small, [group, "part"]).withColumn("node", F.col("before") + F.col("at") - F.col("first")).drop("part", "at", "first", "before")


def hot_join(rows: DataFrame, table: DataFrame, on: list[str], n: str, most: int = 50_000) -> DataFrame:
    """``rows`` joined with ``table``, which has each key once and in column ``n`` (dropped) how many rows have it.

    Keys with more than a ``most``-th of all rows go out by broadcast, at most
    ``most`` of them; no other key is large enough to make a task long.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    limit = max(500, total // most)
    hot = F.broadcast(table.where(F.col(n) > limit).drop(n))
    cold = table.where(F.col(n) <= limit).drop(n)
    return rows.join(hot, on).union(rows.join(hot, on, "left_anti").join(cold.hint("merge"), on).select(*rows.join(hot, on).columns))
