"""Findings kept by key, and the selection of articles to check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.operators.common import latest
from corrobora.sources.shared import materialize

KEY = ["wiki", "page_id", "claim_hash", "source_url_hash", "provider", "prompt_version"]
#: Columns that an update leaves as they were first written.
KEPT = ["created_at"]

#: Criteria and the templates that mark their articles.
CRITERIA = {"failed-verification": "Failed_verification", "citation-needed": "Citation_needed", "unreliable-source": "Unreliable_source?"}


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str], kept: list[str] = KEPT) -> DataFrame:
    """``old`` with ``new``'s rows written over those of equal key; the last of a key in ``new`` wins.

    Nulls in keys are equal. Columns in ``kept`` stay those of the first write.
    One full join on the key; both sides are deduplicated by it.
    """
    fresh = latest(new, keys, order).select(*(F.col(c).alias(f"n_{c}") for c in new.columns), F.lit(True).alias("_new"))
    on = [F.col(k).eqNullSafe(F.col(f"n_{k}")) for k in keys]
    both = old.withColumn("_old", F.lit(True)).join(fresh, on, "full")
    out = []
    for c in old.columns:
        if c in kept:
            out.append(F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"n_{c}")).alias(c))
        else:
            out.append(F.when(F.col("_new"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c))
    return both.select(*out)


def criterion(name: str) -> str:
    if name not in CRITERIA:
        raise ValueError(f"unknown selection criterion: {name} (known: {', '.join(CRITERIA)})")
    return CRITERIA[name]


def candidates(links: DataFrame, targets: DataFrame, pages: DataFrame, template: str, after: int = 0, most: int = 500) -> DataFrame:
    """Pages that use a template, by page_id above ``after``: at most ``most`` of them.

    links: tl_from, tl_target_id, tl_from_namespace; targets: lt_id, lt_namespace,
    lt_title; pages: page_id, page_title, page_latest, page_namespace,
    page_is_redirect.
    """
    if not 1 <= most <= 5000 or after < 0:
        raise ValueError(f"most must be in 1..5000 and after not negative, not {most} and {after}")
    marks = targets.where((F.col("lt_namespace") == 10) & (F.col("lt_title") == template)).select("lt_id")
    used = links.where((F.col("tl_from_namespace") == 0) & (F.col("tl_from") > after)).join(marks, F.col("tl_target_id") == F.col("lt_id"), "left_semi")
    own = pages.where((F.col("page_namespace") == 0) & (F.col("page_is_redirect") == 0) & (F.col("page_id") > after))
    found = own.join(used.select(F.col("tl_from").alias("page_id")), "page_id", "left_semi")
    title = F.replace(F.col("page_title").cast("string"), F.lit("_"), F.lit(" "))
    return found.orderBy("page_id").limit(most).select("page_id", title.alias("title"), F.col("page_latest").cast("long").alias("revision_id"))


def all_candidates(read: Callable[[int, int], DataFrame], most: int = 500, page: int = 500) -> DataFrame:
    """Candidates page by page until a short page or ``most`` rows: what a source that answers in pages gives.

    ``read(after, limit)`` is one page, such as :func:`candidates` over tables or a
    replica's query. Each page is written once, so that what follows does not ask
    the source again; the driver keeps only its size and its last page_id. Where
    the source is a table of Spark's, one call of :func:`candidates` does the same.
    """
    if most < 1 or page < 1:
        raise ValueError(f"most and page must be positive, not {most} and {page}")
    found, rows, after = None, 0, 0
    while rows < most:
        limit = min(page, most - rows)
        part = materialize(read(after, limit), "page")
        size, last = part.agg(F.count("*"), F.max("page_id")).first()
        found = part if found is None else found.union(part) if size else found
        rows += size
        if size < limit:
            break
        if last <= after:
            raise ValueError(f"a page of a source did not pass {after}")
        after = last
    return found
