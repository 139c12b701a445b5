"""Running models over a dataset, extracting one, and what may be published."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.functions.quotes import check
from corrobora.functions.replies import parsed
from corrobora.functions.text import extraction_status, share, source_text, user_prompt
from corrobora.functions.urls import source_key, wiki_title
from corrobora.functions.verdicts import canonical, runner_label, score, truth_label
from corrobora.operators.citations import extract_citations
from corrobora.operators.common import has_error, ready
from corrobora.operators.runs import open_tasks, reload
from corrobora.sources.fetch import fetch_with_retry, with_retry
from corrobora.sources.shared import materialize

ANSWER = "text string, tokens_in int, tokens_out int, cost_usd double, latency_ms long, error string"


def run(dataset: DataFrame, models: Mapping[str, Callable[[str], dict]], names: Mapping[str, str], slots: int = 5, done: DataFrame | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """One result for each usable entry and model: asked, read, scored, its quote checked.

    ``models`` maps a provider to a callable from prompt to {text, tokens_in,
    tokens_out, cost_usd}; ``names`` to its model's name. At most ``slots``
    tasks of one provider run at a time. A failed call is a row with verdict
    ERROR. ``done`` holds results that are not asked for again.
    """
    entries = ready(dataset)
    tasks = entries.select(F.col("id").alias("entry_id"), "ground_truth", "source_text", user_prompt("claim_text", "source_text").alias("prompt"))
    pairs = tasks.select("entry_id")
    finished = reload(done, list(models), resume=True) if done is not None else None
    empty = pairs.limit(0).withColumn("provider", F.lit(""))
    todo = open_tasks(pairs, list(models), finished if finished is not None else empty)
    dealt = todo.join(tasks, "entry_id").withColumn("slot", F.pmod(F.xxhash64("entry_id"), F.lit(slots))).repartition("provider", "slot")

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for provider, prompt in zip(frame["provider"], frame["prompt"], strict=True):
                start = time.monotonic()
                try:
                    got = with_retry(lambda p=provider, q=prompt: models[p](q), sleep=sleep) | {"error": None}
                except Exception as error:
                    got = {"text": None, "error": str(error)}
                rows.append({"latency_ms": int((time.monotonic() - start) * 1000)} | got)
            out = pd.DataFrame(rows, columns=["text", "tokens_in", "tokens_out", "cost_usd", "latency_ms", "error"])
            out = out.astype({"tokens_in": "Int32", "tokens_out": "Int32", "cost_usd": "float64"})
            yield pd.concat([frame[["entry_id", "provider", "ground_truth", "source_text"]].reset_index(drop=True), out], axis=1)

    asked = dealt.select("entry_id", "provider", "ground_truth", "source_text", "prompt").mapInPandas(ask, f"entry_id string, provider string, ground_truth string, source_text string, {ANSWER}")
    read = asked.withColumn("r", parsed("text")).withColumn("q", check(source_text(F.coalesce("source_text", F.lit(""))), F.when(~has_error(), F.col("r.source_quote"))))
    model = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("provider")]
    verdict = F.when(has_error(), "ERROR").otherwise(runner_label("r.verdict"))
    return read.select(
        "entry_id", "provider", model.alias("model"), "ground_truth", verdict.alias("predicted_verdict"), F.when(has_error(), 0).otherwise(F.coalesce("r.confidence", F.lit(0))).alias("confidence"),
        F.when(has_error(), F.col("error")).otherwise(F.col("r.comments")).alias("comments"), F.when(has_error(), "").otherwise(F.col("r.source_quote")).alias("source_quote"), F.col("q.status").alias("quote_status"), F.col("q.verified").alias("quote_verified"),
        "latency_ms", "error", score(verdict, "ground_truth", "error").alias("correct"), "tokens_in", "tokens_out", "cost_usd", F.current_timestamp().alias("timestamp"),
    )


def extract_dataset(rows: DataFrame, article: Callable[[str], str], source: Callable[[str, int | None], dict], sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Dataset entries of a table of citations to check.

    rows: row, article_url, citation_number, occurrence, ground_truth,
    dataset_version, claim_override, url_override. Overrides replace what would
    be extracted, fetches that fail for a while are tried three times, and an article all of whose rows have both is not fetched. An
    article that cannot be had gives entries that say so.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rows = rows.withColumns({"whole": ~blank("claim_override") & ~blank("url_override"), "occurrence": F.coalesce("occurrence", F.lit(1))})
    wanted = rows.where(~F.col("whole")).select("article_url").distinct()

    def fetch_page(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pages, errors = [], []
            for url in frame["article_url"]:
                try:
                    pages.append(with_retry(lambda u=url: article(u), 3, sleep=sleep))
                    errors.append(None)
                except Exception as error:
                    pages.append(None)
                    errors.append(str(error))
            yield pd.DataFrame({"article_url": frame["article_url"], "html": pages, "failure": errors})

    pages = materialize(wanted.mapInPandas(fetch_page, "article_url string, html string, failure string"), "pages")  # read twice, fetched once
    found = extract_citations(pages.select(F.col("article_url").alias("doc_id"), "html"))
    cited = found.select(F.col("doc_id").alias("article_url"), "citation_number", F.col("occurrence").alias("at"), "total_occurrences", F.col("claim_text").alias("found_claim"), F.col("url").alias("found_url"))
    joined = rows.join(pages.select("article_url", "failure"), "article_url", "left")
    pick = F.when(F.col("total_occurrences") >= F.col("occurrence"), F.col("at") == F.col("occurrence")).otherwise(F.col("at") == 1)
    joined = joined.join(cited, ["article_url", "citation_number"], "left").where(F.col("at").isNull() | pick)
    failed = ~F.col("whole") & F.col("failure").isNotNull()
    claim = F.when(failed, "").otherwise(F.coalesce(F.nullif(F.trim("claim_override"), F.lit("")), "found_claim", F.lit("")))
    url = F.when(failed, None).otherwise(F.coalesce(F.nullif(F.trim("url_override"), F.lit("")), F.col("found_url")))
    resolved = joined.withColumns({"claim_text": claim, "source_url": url, "key": source_key(url, F.lit(0))})

    def fetch_text(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = []
            for address in frame["key"]:
                try:
                    texts.append(fetch_with_retry(source, address, None, sleep=sleep).get("content"))
                except Exception:
                    texts.append(None)
            yield frame.assign(source_text=texts)

    texts = resolved.where(F.col("key").isNotNull()).select("key").distinct().mapInPandas(fetch_text, "key string, source_text string")
    full = resolved.join(texts, "key", "left")
    text = F.coalesce("source_text", F.lit(""))
    return full.select(
        F.concat(F.lit("row_"), F.col("row").cast("string")).alias("id"), "article_url", F.coalesce(wiki_title("article_url"), F.lit("")).alias("article_title"), "citation_number", "occurrence",
        F.when(blank("claim_override"), F.coalesce("total_occurrences", F.lit(0))).alias("total_occurrences"), "claim_text", F.coalesce("source_url", F.lit("")).alias("source_url"), text.alias("source_text"),
        truth_label("ground_truth").alias("ground_truth"), F.coalesce(F.nullif("dataset_version", F.lit("")), F.lit("v1")).alias("dataset_version"),
        F.when(failed, "article_fetch_failed").otherwise(extraction_status("claim_text", "source_url", text)).alias("extraction_status"), ((F.col("claim_text") == "") | (text == "")).alias("needs_manual_review"),
    )


def publishable(findings: DataFrame, least: int = 80, contradictions_only: bool = False) -> DataFrame:
    """Findings fit to be shown: NOT SUPPORTED with high confidence, contradictions first; an unavailable source never."""
    fit = (canonical("verdict") == "NOT SUPPORTED") & (F.col("confidence") >= least)
    contradiction = F.coalesce(F.col("reason_type") == "contradiction", F.lit(False))
    return findings.where(fit & contradiction if contradictions_only else fit).withColumn("priority", F.when(contradiction, 1).otherwise(2))


def flag_precision(results: DataFrame, thresholds: list[int]) -> DataFrame:
    """Precision and recall of NOT SUPPORTED at each least confidence."""
    said, true = canonical("predicted_verdict") == "NOT SUPPORTED", canonical("ground_truth") == "NOT SUPPORTED"
    at = F.explode(F.array(*map(F.lit, thresholds)))
    rows = results.where(~has_error()).select("provider", F.coalesce(said, F.lit(False)).alias("s"), F.coalesce(true, F.lit(False)).alias("t"), F.coalesce("confidence", F.lit(0)).alias("c"), at.alias("threshold"))
    flagged = F.col("s") & (F.col("c") >= F.col("threshold"))
    sums = rows.groupBy("provider", "threshold").agg(F.count_if(flagged).alias("flagged"), F.count_if(flagged & F.col("t")).alias("right"), F.count_if("t").alias("positive"))
    return sums.select("provider", "threshold", "flagged", "right", share(F.col("right"), F.col("flagged")).alias("precision"), share(F.col("right"), F.col("positive")).alias("recall"))


def with_expiry(findings: DataFrame, days: int = 90) -> DataFrame:
    """Adds when a finding's source should be fetched anew."""
    return findings.withColumn("expires_at", F.col("fetched_at") + F.make_dt_interval(days=F.lit(days)))
