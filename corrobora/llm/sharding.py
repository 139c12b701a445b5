"""Rendezvous hashing of stable record keys over weighted shards.

Each shard draws a number in (0, 1) from a hash of the record's key and its own
name; the record goes to the shard with the highest score -weight / ln(draw).
A further shard can only take records to itself, and with weights a shard
gets its share of the records. Only the key and the set of shards decide, so
the law is ``key``: no state. Slots number a shard's records from
0 without gaps, in two steps (counts for each sub-bucket, then a window in
it), so a shard that holds a large part of the rows is numbered in parallel.
Keys and sizes are written to the shared folder with a number of each row, which
deals the rows to sub-buckets: rows that are equal in all else are spread too,
and both steps read the same buckets.

Defined results: a null text has size 1 and the crc32 of the empty string; a
null key is one key like any other, so its rows share a shard; repeated rows
share a shard and get slots of their own; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrobora.llm.durable import materialize


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The number of the shard with the highest weighted score for ``key``."""
    text = F.coalesce(key.cast("string"), F.lit("\u0000null"))
    shards = []
    for shard, weight in enumerate(weights):
        bits = F.conv(F.substring(F.md5(F.concat(text, F.lit(f"/{shard}"))), 1, 13), 16, 10).cast("double")
        score = F.lit(-float(weight)) / F.log((bits + 0.5) / F.lit(float(1 << 52)))
        shards.append(F.struct(score.alias("score"), F.lit(-shard).alias("shard")))
    return (-F.array_max(F.array(*shards))["shard"]).cast("int")


def shard(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, key: str = "doc_id") -> DataFrame:
    """Shard and slot of every row, and its shard if one more of the mean weight is added.

    Slots are numbered in as many sub-buckets of each shard as the session has
    shuffle partitions, 64 at least: a cluster for more rows has more of them.
    """
    grown = [*weights, sum(weights) / len(weights)]
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), grown).alias("grown_shard"),
        F.monotonically_increasing_id().alias("row"),
    )
    buckets = max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = materialize(rows, "shards").withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    sums = keyed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("shard", "bucket").orderBy("row")
    return (
        keyed.withColumn("inside", F.row_number().over(inside) - 1)
        .join(sums, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("earlier") + F.col("inside")).cast("long").alias("slot"), "grown_shard")
    )
