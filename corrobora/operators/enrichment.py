"""From candidates to findings: fetch, extract, resolve, ask, read, keep.

External work is injected. Every stage's failures are rows: an article that
cannot be had, a source that is missing, a model that raises.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.functions.quotes import check
from corrobora.functions.replies import parsed
from corrobora.functions.text import claim_hash, group_prompt, revision_id, source_text, source_url_hash, truncate_for_log, user_prompt
from corrobora.functions.urls import source_key
from corrobora.operators.citations import extract_citations
from corrobora.operators.groups import assemble
from corrobora.sources.fetch import fetch_articles, resolve_sources, with_retry
from corrobora.sources.shared import materialize


def outcomes(articles: DataFrame, citations: DataFrame) -> DataFrame:
    """Adds each article's outcome: ok, no_citations or fetch_failed, and its number of citations."""
    n = citations.groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.count("*").alias("citations"))
    rows = articles.join(n, "page_id", "left").withColumn("citations", F.coalesce("citations", F.lit(0)))
    return rows.withColumn("outcome", F.when(F.coalesce("html", F.lit("")) == "", "fetch_failed").when(F.col("citations") == 0, "no_citations").otherwise("ok"))


def process(candidates: DataFrame, article: Callable, source: Callable) -> tuple[DataFrame, DataFrame]:
    """(articles with outcomes, citations with sources) of candidates (page_id, title, revision_id)."""
    articles = materialize(fetch_articles(candidates, article), "articles")  # read twice, fetched once
    citations = extract_citations(articles.select(F.col("page_id").alias("doc_id"), "html"))
    return outcomes(articles, citations), materialize(resolve_sources(citations, source), "sources")


def stub_source(url: str, page: int | None) -> dict:
    """In place of a fetch: no source is had."""
    return {"content": None, "status": None, "error": "not fetched (stub)"}


def ask(rows: DataFrame, model: Callable[[str], str], prompt: Column) -> DataFrame:
    """Adds the model's reply, read, and its quote held against the source.

    A row without a source gets SOURCE UNAVAILABLE and confidence 0 without a
    call; a failing call gives ERROR without confidence.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            replies, errors = [], []
            for text in frame["prompt"]:
                reply = error = None
                if text is not None:
                    try:
                        reply = model(text)
                    except Exception as e:
                        error = str(e)
                replies.append(reply)
                errors.append(error)
            yield frame.assign(reply=replies, model_error=errors)

    have = F.coalesce("content", F.lit("")) != ""
    asked = rows.withColumn("prompt", F.when(have, prompt))
    schema = asked._jdf.schema().toDDL() + ", reply string, model_error string"
    read = asked.mapInPandas(run, schema).withColumn("r", F.when(F.col("reply").isNotNull(), parsed("reply")))
    body = source_text(F.coalesce("content", F.lit("")))
    quote = check(body, F.coalesce(F.col("r.source_quote"), F.lit("")))
    reason = F.when(F.col("url").isNull(), "No URL found in reference").otherwise(F.coalesce("error", F.lit("Could not fetch source content")))
    return read.withColumn("q", quote).select(
        *[c for c in rows.columns],
        F.when(~have, "SOURCE UNAVAILABLE").when(F.col("model_error").isNotNull(), "ERROR").otherwise(F.col("r.verdict")).alias("verdict"),
        F.when(~have, 0).otherwise(F.col("r.confidence")).alias("confidence"),
        F.when(~have, reason).when(F.col("model_error").isNotNull(), F.col("model_error")).otherwise(F.col("r.comments")).alias("comments"),
        F.col("r.reason_type").alias("reason_type"), F.coalesce(F.col("r.source_quote"), F.lit("")).alias("source_quote"), F.col("q.status").alias("quote_status"), F.col("q.verified").alias("quote_verified"),
        F.coalesce(F.col("content").contains("\nTruncated: true"), F.lit(False)).alias("truncated"),
    )


def verify(rows: DataFrame, model: Callable[[str], str]) -> DataFrame:
    return ask(rows, model, user_prompt("claim_text", "content"))


def verify_groups(members: DataFrame, claims: DataFrame, model: Callable[[str], str], tries: int = 5, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """One verdict a group on its sources together.

    members: as for ``groups.assemble``; claims: group_id, claim_text. A group
    with at most one source to be had is skipped, since its verdict would be
    that source's. Each other one is one call, tried again while the error may
    pass; its quote is held against the assembled text.
    """
    rows = assemble(members).join(claims, "group_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            replies, errors = [], []
            for text in frame["prompt"]:
                reply = error = None
                if text is not None:
                    try:
                        reply = with_retry(lambda t=text: model(t), tries, base=5.0, jitter=0.0, sleep=sleep)
                    except Exception as e:
                        error = str(e)
                replies.append(reply)
                errors.append(error)
            yield frame.assign(reply=replies, model_error=errors)

    asked = rows.withColumn("prompt", F.when(~F.col("skipped"), group_prompt("claim_text", "text")))
    read = asked.mapInPandas(run, asked._jdf.schema().toDDL() + ", reply string, model_error string").withColumn("r", F.when(F.col("reply").isNotNull(), parsed("reply")))
    failed = F.col("model_error").isNotNull()
    return read.withColumn("q", check("text", F.coalesce(F.col("r.source_quote"), F.lit("")))).select(
        "group_id", "skipped", "sources", "available", F.coalesce("truncated", F.lit(False)).alias("truncated"),
        F.when(F.col("skipped"), None).when(failed, "ERROR").otherwise(F.col("r.verdict")).alias("verdict"), F.when(~F.col("skipped") & ~failed, F.col("r.confidence")).alias("confidence"),
        F.when(failed, F.col("model_error")).otherwise(F.col("r.comments")).alias("comments"), F.col("r.reason_type").alias("reason_type"),
        F.when(~F.col("skipped"), F.coalesce(F.col("r.source_quote"), F.lit(""))).alias("source_quote"), F.when(~F.col("skipped"), F.col("q.status")).alias("quote_status"), F.when(~F.col("skipped"), F.col("q.verified")).alias("quote_verified"),
    )


def as_findings(rows: DataFrame, wiki: str, provider: str, prompt_version: str) -> DataFrame:
    """Verified citations as findings, keyed by the hashes of claim and address."""
    return rows.select(
        F.lit(wiki).alias("wiki"), F.col("doc_id").cast("long").alias("page_id"), claim_hash("claim_text").alias("claim_hash"), source_url_hash("url").alias("source_url_hash"), F.lit(provider).alias("provider"),
        F.lit(prompt_version).alias("prompt_version"), "claim_text", "citation_number", F.col("url").alias("source_url"), "verdict", "confidence", "reason_type", F.col("comments").alias("rationale"),
        F.col("status").alias("fetch_status"), F.col("truncated").alias("source_truncated"), "group_id", "pos", F.current_timestamp().alias("created_at"),
    )


def extraction_totals(citations: DataFrame) -> DataFrame:
    key = source_key("url", "page_num")
    return citations.agg(
        F.count("*").alias("citations"), F.count("url").alias("with_url"), F.count_if(F.coalesce("content", F.lit("")) != "").alias("fetched"),
        F.count_if(F.col("unavailable_reason") == "fetch_failed").alias("failed"), F.count_distinct(key).alias("sources"),
    )


#: Columns of a check's log entry.
LOGGED = ["check_id", "kind", "article_url", "article_title", "revision_id", "citation_number", "source_url", "provider", "model", "verdict", "confidence", "reason_type", "claim_text", "llm_comments", "source_quote", "quote_status"]


def log_payload(rows: DataFrame) -> DataFrame:
    """The 16 columns of a log entry; texts are trimmed and cut, missing columns are null."""
    have = set(rows.columns)
    made = {"kind": F.coalesce("kind", F.lit("source")) if "kind" in have else F.lit("source")}
    for c in ("claim_text", "source_quote"):
        made[c] = truncate_for_log(c) if c in have else F.lit(None).cast("string")
    made["llm_comments"] = truncate_for_log("comments") if "comments" in have else F.lit(None).cast("string")
    made["revision_id"] = revision_id("revision_id") if "revision_id" in have else F.lit(None).cast("long")
    return rows.select(*((made[c] if c in made else F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in LOGGED))


def feedback_payload(rows: DataFrame) -> DataFrame:
    columns = ["check_id", "rating", "corrected_verdict", "wiki_section", "client_id"]
    return rows.select(*((F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in columns))
