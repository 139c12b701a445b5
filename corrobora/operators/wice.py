"""Evaluation entries from sentence-labelled evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.functions.urls import encode_component
from corrobora.functions.verdicts import truth_label

MARK, FIELD = r"^\(meta data\)\s*", r"^\(meta data\)\s*([A-Z][A-Z ]*):\s*(.*)$"
MOST_CHARS = 50_000


def kept_sentences(sentences: Column, most: int = MOST_CHARS) -> Column:
    """How many whole sentences fit, joined by spaces, before the first that does not."""
    step = F.aggregate(
        sentences, F.struct(F.lit(0).alias("chars"), F.lit(0).alias("n"), F.lit(True).alias("open")),
        lambda acc, s: F.struct(
            (acc["chars"] + F.char_length(s) + F.when(acc["n"] == 0, 0).otherwise(1)).alias("chars"),
            (acc["n"] + F.when(acc["open"] & (acc["chars"] + F.char_length(s) + F.when(acc["n"] == 0, 0).otherwise(1) <= most), 1).otherwise(0)).alias("n"),
            (acc["open"] & (acc["chars"] + F.char_length(s) + F.when(acc["n"] == 0, 0).otherwise(1) <= most)).alias("open"),
        ),
    )
    return step["n"]


def projection(labels: Column) -> Column:
    """``unknown`` without labels, ``unanimous`` with one, else ``mixed``."""
    n = F.size(F.array_distinct(labels))
    return F.when(F.coalesce(n, F.lit(0)) <= 0, "unknown").when(n == 1, "unanimous").otherwise("mixed")


def supporting(sets: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.coalesce(sets, F.array().cast("array<array<int>>")))))


def source_meta(evidence: Column, key: str) -> Column:
    """The first value of a metadata field, null where blank."""
    hits = F.filter(evidence, lambda s: (F.regexp_extract(s, FIELD, 1) == key) & (F.trim(F.regexp_extract(s, FIELD, 2)) != ""))
    return F.trim(F.regexp_extract(F.get(hits, F.lit(0)), FIELD, 2))


def subclaim_labels(subclaims: DataFrame) -> DataFrame:
    """wice_id and its subclaims' labels in order (columns pos, id, label; a subclaim's id ends in -n)."""
    own = F.regexp_replace("id", "-[0-9]+$", "")
    rows = subclaims.where(F.col("id").isNotNull()).groupBy(own.alias("wice_id")).agg(F.array_sort(F.collect_list(F.struct("pos", "label"))).alias("s"))
    return rows.select("wice_id", F.transform("s", lambda x: x["label"]).alias("labels"))


def convert(claims: DataFrame, subclaims: DataFrame, split: str, most: int = MOST_CHARS) -> DataFrame:
    """Dataset rows of one split (claims: id, label, claim, evidence, supporting_sentences, claim_title, claim_section, claim_context)."""
    rows = claims.withColumnRenamed("id", "wice_id").join(subclaim_labels(subclaims), "wice_id", "left")
    rows = rows.withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>"))).withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
    rows = rows.withColumn("cleaned", F.transform("evidence", lambda s: F.regexp_replace(s, MARK, ""))).withColumn("kept", kept_sentences(F.col("cleaned"), most)).withColumn("support", supporting(F.col("supporting_sentences")))
    title, context = F.nullif(F.col("claim_title"), F.lit("")), F.coalesce("claim_context", F.lit(""))
    lost = F.exists("support", lambda i: i >= F.col("kept"))
    return rows.select(
        F.concat(F.lit("wice_"), "wice_id").alias("id"),
        F.concat(F.lit("https://en.wikipedia.org/wiki/"), encode_component(F.replace(title, F.lit(" "), F.lit("_")))).alias("article_url"), title.alias("article_title"),
        F.col("claim").alias("claim_text"), F.when(context != "", F.concat(context, F.lit(" "), "claim")).otherwise(F.col("claim")).alias("claim_container"),
        F.array_join(F.slice("cleaned", F.lit(1), F.col("kept")), " ").alias("source_text"), truth_label("label").alias("ground_truth"), F.lit("wice").alias("dataset_version"), F.lit("complete").alias("extraction_status"),
        lost.alias("needs_manual_review"), "wice_id", F.lit(split).alias("wice_split"), F.nullif(F.col("claim_section"), F.lit("")).alias("wice_section"), F.col("label").alias("wice_label"),
        F.size("labels").alias("wice_subclaim_count"), F.col("labels").alias("wice_subclaim_labels"), projection(F.col("labels")).alias("wice_label_projection"), F.col("support").alias("wice_supporting_sentences"),
        F.size("evidence").alias("wice_evidence_sentence_count"), (F.col("kept") < F.size("cleaned")).alias("wice_source_truncated"), lost.alias("wice_truncated_supporting"),
        source_meta(F.col("evidence"), "TITLE").alias("source_title"), source_meta(F.col("evidence"), "PUBLISHER").alias("source_publisher"),
    )


def summary(rows: DataFrame) -> DataFrame:
    """Tallies by split, ground truth and projection, in one pass; and how many were cut or need review."""
    sets = rows.groupingSets([["wice_split"], ["ground_truth"], ["wice_label_projection"], []], "wice_split", "ground_truth", "wice_label_projection")
    out = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if("wice_source_truncated").alias("truncated"), F.count_if("needs_manual_review").alias("flagged"))
    kind = F.when(F.col("g") == 3, "split").when(F.col("g") == 5, "ground_truth").when(F.col("g") == 6, "projection").otherwise("total")
    return out.select(kind.alias("tally"), F.coalesce("wice_split", "ground_truth", "wice_label_projection", F.lit("all")).alias("value"), "n", "truncated", "flagged")
