"""Articles, sources and model replies from outside, by injected callables.

Calls are made in Arrow batches on the executors, each distinct key once:
keys are deduplicated before and results joined back after. A failing call is a
row with its error, never a failed task. Results should be written before they
are used twice, since a task that runs again calls again.
"""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.functions.urls import host, is_google_books, raw_archive, source_key

#: Errors worth another try.
RETRYABLE_STATUS = re.compile(r"^(?:HTTP |[^:()]*API request failed \()(429|500|502|503|504)\b")
RETRYABLE_NETWORK = re.compile(r"timeout|ECONNRESET|ETIMEDOUT|ENOTFOUND|EAI_AGAIN|socket hang up", re.I)
SOURCE = "content string, status int, error string"


def is_retryable(message: str) -> bool:
    return bool(RETRYABLE_STATUS.search(message) or RETRYABLE_NETWORK.search(message))


def exit_code(message: str) -> int:
    """11: an unusable reply, 9: the request's fault, 10: the service's or the network's."""
    if re.search(r"Invalid API response format|ran out of output budget", message, re.I):
        return 11
    status = re.search(r"\((\d{3})\)", message)
    return 9 if status and 400 <= int(status[1]) < 500 else 10


def backoff(attempt: int, base: float = 1.0, cap: float = 30.0, jitter: float = 0.5) -> float:
    return min(cap, base * 2**attempt) + random.random() * jitter


def with_retry(call: Callable[[], object], tries: int = 5, base: float = 1.0, cap: float = 30.0, jitter: float = 0.5, sleep: Callable[[float], None] = time.sleep):
    """The call's result; errors that may pass are tried again, others raised."""
    for attempt in range(tries):
        try:
            return call()
        except Exception as error:
            if attempt + 1 == tries or not is_retryable(str(error)):
                raise
            sleep(backoff(attempt, base, cap, jitter))
    return None


def shape_reply(content: str | None, truncated: bool = False, source_url: str = "", status: int | None = 200, pages: int | None = None, page: int | None = None) -> dict:
    """A proxy's reply as a source: framed text, or why there is none."""
    if not content or len(content) <= 100:
        return {"content": None, "status": status, "error": "Source content was empty or too short to verify"}
    head = f"Source URL: {source_url}"
    if pages:
        head += f"\nPDF: {pages} pages" + (f" (extracted page {page})" if page else "")
    if truncated or len(content) >= 12_000:
        head += "\nTruncated: true"
    return {"content": f"{head}\n\nSource Content:\n{content}", "status": status, "error": None}


def fetch_source(url: str, page: int | None, proxy: Callable[[str, int | None], dict], snapshot: Callable[[str], str | None] | None = None) -> dict:
    """A live source, else its archived snapshot; an archive's address is read raw, book previews are skipped."""
    if re.search(r"books\.google\.", url):
        return {"content": None, "status": None, "error": "Google Books URL skipped (no fetchable content)"}
    if m := re.match(r"^https?://web\.archive\.org/web/(\d+)(?:id_)?/(https?://.+)$", url):
        return _safe(proxy, f"https://web.archive.org/web/{m[1]}id_/{m[2]}", page)
    got = _safe(proxy, url, page)
    if not got["content"] and snapshot:
        try:
            kept = snapshot(url)
        except Exception:  # no snapshot is known: the live answer stands
            kept = None
        if kept:
            return _safe(proxy, kept, page)
    return got


def find_snapshot(url: str, get: Callable[[str], dict]) -> str | None:
    """The raw address of the closest archived snapshot of a page; ``get`` gives the parsed answer of an address."""
    closest = ((get(f"https://archive.org/wayback/available?url={quote(url, safe='')}") or {}).get("archived_snapshots") or {}).get("closest") or {}
    if not closest.get("available") or not closest.get("timestamp"):
        return None
    return f"https://web.archive.org/web/{closest['timestamp']}id_/{url}"


def pdf_source(pages: Sequence[str], url: str, page: int | None = None) -> dict:
    """The text layer of a PDF, read elsewhere page by page, as a source: one page (from 1) or all."""
    if page is not None and not 1 <= page <= len(pages):
        return {"content": None, "status": None, "error": f"The PDF has {len(pages)} pages, not {page}"}
    return shape_reply("\n\n".join(pages) if page is None else pages[page - 1], source_url=url, pages=len(pages), page=page)


def fetch_with_retry(fetch: Callable[..., dict], *arguments, tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> dict:
    """A fetch that is tried again where it raises, or answers with an error, that may pass."""

    def call() -> dict:
        got = fetch(*arguments) or {}
        if not got.get("content") and (message := f"HTTP {got['status']}" if got.get("status") else str(got.get("error") or "")) and is_retryable(message):
            last.append(got)
            raise RuntimeError(message)
        return got

    last: list[dict] = []
    try:
        return with_retry(call, tries, sleep=sleep)
    except Exception:
        if last:
            return last[-1]
        raise


def _safe(call: Callable[..., dict], *arguments) -> dict:
    try:
        got = call(*arguments) or {}
        return {"content": got.get("content"), "status": got.get("status"), "error": got.get("error")}
    except Exception as error:
        return {"content": None, "status": None, "error": str(error)}


def resolve_sources(citations: DataFrame, fetch: Callable[[str, int | None], dict], slots: int = 5) -> DataFrame:
    """Adds content, status, error and unavailable_reason to citations (url, page_num).

    Each distinct (url, page) is fetched once, at most ``slots`` at a time for
    a host: a host's keys are dealt to so many partitions.
    """
    key = source_key("url", "page_num")
    keys = citations.where(F.col("url").isNotNull()).select("url", "page_num", key.alias("key")).dropDuplicates(["key"])
    dealt = keys.withColumn("slot", F.pmod(F.xxhash64("key"), F.lit(slots))).repartition(host("url"), "slot")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [_safe(fetch, u, None if pd.isna(p) else int(p)) for u, p in zip(frame["url"], frame["page_num"], strict=True)]
            out = pd.DataFrame(rows, columns=["content", "status", "error"]).assign(key=frame["key"].to_numpy())
            yield out.astype({"status": "Int32"})[["key", "content", "status", "error"]]

    fetched = dealt.select("url", "page_num", "key").mapInPandas(run, f"key string, {SOURCE}")
    joined = citations.withColumn("key", key).join(fetched, "key", "left").drop("key")
    reason = F.when(F.col("url").isNull(), "no_url").when(F.coalesce("content", F.lit("")) == "", "fetch_failed")
    return joined.withColumn("unavailable_reason", reason)


def fetch_articles(candidates: DataFrame, fetch: Callable[[str, int], dict]) -> DataFrame:
    """Adds html, fetch_status, error and outcome to candidates (page_id, title, revision_id)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for title, revision in zip(frame["title"], frame["revision_id"], strict=True):
                try:
                    got = fetch(title, int(revision)) or {}
                except Exception as error:
                    got = {"error": str(error)}
                rows.append({"html": got.get("html"), "fetch_status": got.get("status"), "error": got.get("error")})
            out = pd.concat([frame.reset_index(drop=True), pd.DataFrame(rows, columns=["html", "fetch_status", "error"])], axis=1)
            yield out.astype({"fetch_status": "Int32"})

    return candidates.select("page_id", "title", "revision_id").mapInPandas(run, "page_id long, title string, revision_id long, html string, fetch_status int, error string")


def google_books(citations: DataFrame) -> DataFrame:
    """Adds what is known of a source's address before it is fetched."""
    return citations.withColumns({"skipped": is_google_books("url"), "raw_url": F.coalesce(raw_archive("url"), "url")})
