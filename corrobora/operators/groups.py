"""Runs of adjacent rows, groups of sources, and the units of a report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrobora.functions.text import js_trim, source_text


def islands(rows: DataFrame, keys: Sequence[str], order: str, breaks: Column) -> DataFrame:
    """Adds island, group_size and group_index: rows of a key in order, a new island where ``breaks`` holds.

    ``breaks`` may use lag over the same window: ``F.lag(...).over(ordered(keys, order))``.
    """
    w = ordered(keys, order)
    marked = rows.withColumn("_new", F.coalesce(breaks, F.lit(False)).cast("int"))
    marked = marked.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    own = Window.partitionBy(*keys, "island")
    return marked.withColumns({"group_size": F.count("*").over(own), "group_index": F.row_number().over(own.orderBy(order)) - 1})


def ordered(keys: Sequence[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def occurrence(keys: Sequence[str], order: str) -> Column:
    return F.row_number().over(ordered(keys, order))


def assemble(members: DataFrame) -> DataFrame:
    """One labelled text a group from its members' sources (group_id, group_index, citation_number, url, page_num, content, status, error).

    Members of one source are merged, in the order of the first; a source that
    could not be had is named with the reason.
    """
    number = F.coalesce("page_num", F.lit(0))
    key = F.when(F.col("url").isNull(), F.concat(F.lit("__nourl_"), F.col("citation_number"))).when(number != 0, F.concat("url", F.lit("|page="), number.cast("string"))).otherwise(F.col("url"))
    first = F.min_by(F.struct("url", "content", "status", "error"), "group_index")
    sources = members.withColumn("key", key).groupBy("group_id", "key").agg(
        F.min("group_index").alias("at"), F.array_sort(F.collect_list(F.struct("group_index", "citation_number"))).alias("numbers"), first.alias("s"),
    )
    text = js_trim(source_text(F.coalesce(F.col("s.content"), F.lit(""))))
    label = F.concat(F.lit("Source "), F.array_join(F.transform("numbers", lambda n: F.concat(F.lit("["), n["citation_number"], F.lit("]"))), ""), F.coalesce(F.concat(F.lit(" ("), F.col("s.url"), F.lit(")")), F.lit("")), F.lit(":\n"))
    reason = F.coalesce(F.concat(F.lit("HTTP "), F.col("s.status").cast("string")), F.nullif(F.col("s.error"), F.lit("")), F.lit("could not be retrieved"))
    block = F.concat(label, F.when(text != "", text).otherwise(F.concat(F.lit("[This source could not be retrieved: "), reason, F.lit("]"))))
    blocks = sources.select("group_id", "at", block.alias("block"), (text != "").alias("available"), F.coalesce(F.col("s.content").contains("\nTruncated: true"), F.lit(False)).alias("cut"))
    return blocks.groupBy("group_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "block"))), lambda b: b["block"]), "\n\n").alias("text"),
        F.count("*").alias("sources"), F.count_if("available").alias("available"), F.max("cut").alias("truncated"),
    ).withColumn("skipped", F.col("available") <= 1)


def report_units(results: DataFrame, collective: DataFrame) -> DataFrame:
    """What a report lists: solo results, one row for a judged group, the members of a skipped one; pending groups wait.

    results: pos, group_id, group_size, verdict; collective: group_id, skipped,
    verdict. Members of a skipped group stand where its first one does.
    """
    grouped = F.coalesce("group_size", F.lit(1)) > 1
    firsts = results.where(grouped).groupBy("group_id").agg(F.min("pos").alias("at"), F.count("*").alias("members"))
    state = firsts.join(collective.select("group_id", "skipped", F.col("verdict").alias("group_verdict")), "group_id")
    solo = results.where(~grouped).select(F.col("pos").alias("at"), "pos", F.lit("solo").alias("kind"), "verdict", F.lit(1).cast("long").alias("citations"))
    judged = state.where(~F.col("skipped")).select("at", F.col("at").alias("pos"), F.lit("group").alias("kind"), F.col("group_verdict").alias("verdict"), F.col("members").alias("citations"))
    members = results.where(grouped).join(state.where("skipped").select("group_id", "at"), "group_id").select("at", "pos", F.lit("member").alias("kind"), "verdict", F.lit(1).cast("long").alias("citations"))
    return solo.unionByName(judged).unionByName(members)


#: A report's buckets.
BUCKETS = {"SUPPORTED": "supported", "PARTIALLY SUPPORTED": "partial", "NOT SUPPORTED": "not_supported", "SOURCE UNAVAILABLE": "unavailable"}


def bucket(verdict: Column, other: str = "error") -> Column:
    """A verdict's bucket; reports on screen call the rest an error, wikitext reports unavailable."""
    out = F.lit(other)
    for name, b in BUCKETS.items():
        out = F.when(verdict == name, b).otherwise(out)
    return out


def report_counts(units: DataFrame, other: str = "error") -> DataFrame:
    return units.groupBy(bucket(F.col("verdict"), other).alias("bucket")).agg(F.count("*").alias("units"), F.sum("citations").alias("citations"))


def visible(units: DataFrame, hidden: Sequence[str] = ("supported",)) -> DataFrame:
    """Units whose bucket is not hidden; pending ones (no verdict) stay."""
    return units.where(F.col("verdict").isNull() | ~bucket(F.col("verdict")).isin(*hidden))


def section_number(rows: DataFrame, keys: Sequence[str], order: str, is_heading: Column) -> DataFrame:
    """Adds section: how many headings stand before a row."""
    w = ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.sum(is_heading.cast("int")).over(w))


