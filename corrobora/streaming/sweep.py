"""Edits gathered into a log, each once: in batches and as a stream."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corrobora.sources.shared import materialize

KEY = ["wiki", "revid"]


def matching(changes: DataFrame, match: str) -> DataFrame:
    """Changes whose comment contains the text, whatever its case."""
    return changes.where(F.contains(F.lower(F.coalesce("comment", F.lit(""))), F.lit(match.lower())))


def within(changes: DataFrame, hours: int, now: F.Column, column: str = "timestamp") -> DataFrame:
    return changes.where((F.col(column) >= now - F.make_interval(hours=F.lit(hours))) & (F.col(column) <= now))


def sweep(changes: DataFrame, log: DataFrame, match: str, first_seen: F.Column, keys: list[str] = KEY) -> DataFrame:
    """New log rows: matching changes that the log lacks, one a key."""
    fresh = matching(changes, match).join(log.select(*keys), keys, "left_anti")
    return fresh.dropDuplicates(keys).withColumn("first_seen", first_seen)


def stream_within(changes: DataFrame, match: str, event_time: str, late: str = "48 hours", keys: list[str] = KEY) -> DataFrame:
    """The same over a stream, with state bounded by how late an edit may come."""
    timed = changes.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return matching(timed, match).withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)


def stream_exact(changes: DataFrame, match: str, path: str, checkpoint: str, keys: list[str] = KEY) -> StreamingQuery:
    """Appends to the log at ``path`` what it lacks, exactly once a key, by an anti-join with the log in each batch.

    A batch that is run again finds its own rows in the log and adds none.
    """

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        rows = matching(batch, match).dropDuplicates(keys)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            rows = rows.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
        rows.withColumn("first_seen", F.current_timestamp()).write.mode("append").parquet(path)

    return changes.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def logged_between(spark: SparkSession, path: str, first, last) -> DataFrame:
    """Rows of a log kept by ``day`` from one day to another, and those without a day; other days' files stay unread."""
    log = spark.read.parquet(path)
    return log.where(F.col("day").isNull() | F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def stream_by_day(changes: DataFrame, match: str, path: str, checkpoint: str, slack: int = 2, event_time: str = "timestamp", keys: list[str] = KEY) -> StreamingQuery:
    """The same as ``stream_exact`` at a cost that doesn't grow with the log: it lies in a folder a day of the edit.

    A batch reads the log's days from ``slack`` days before its first edit to
    ``slack`` after its last: how far apart two reports may date one edit. Edits
    without a time lie by themselves and are read by every batch; a batch that
    has such edits reads all days, since their first report may have had a time.
    """

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = matching(batch, match).dropDuplicates(keys).withColumn("day", F.to_date(F.substring(event_time, 1, 10)))
        rows = materialize(rows, "batch")
        first, last, n, timed = rows.agg(F.min("day"), F.max("day"), F.count("*"), F.count("day")).first()
        if not n:
            return
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            near = logged_between(spark, path, first - timedelta(slack), last + timedelta(slack)) if timed == n else spark.read.parquet(path)
            rows = rows.join(near.select(*keys), keys, "left_anti")
        rows.withColumn("first_seen", F.current_timestamp()).hint("rebalance", F.col("day")).write.mode("append").partitionBy("day").parquet(path)

    return changes.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
