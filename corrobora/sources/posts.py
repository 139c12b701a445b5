"""Log entries and ratings sent to a service through an injected ``post(url, headers, body)`` -> ``(status, reply)``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Post = Callable[[str, dict, dict], tuple[int, dict]]
HEADERS = {"Content-Type": "application/json"}


def post_log(base: str, payload: dict, post: Post) -> bool:
    """Sends a log entry; a failure is told by False and never raised, since logging must not break a check."""
    try:
        status, _ = post(f"{base}/log", HEADERS, payload)
    except Exception:
        return False
    return 200 <= status < 300


def post_feedback(base: str, payload: dict, post: Post) -> bool:
    """Sends a rating; a failure is raised, since a person waits for it."""
    status, _ = post(f"{base}/feedback", HEADERS, payload)
    if not 200 <= status < 300:
        raise RuntimeError(f"Feedback failed: HTTP {status}")
    return True


def send_logs(payloads: DataFrame, base: str, post: Post) -> DataFrame:
    """check_id and whether its entry was taken, for every row of ``log_payload``; write the result before it is used twice."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = frame.astype(object).where(frame.notna(), None).to_dict("records")
            yield pd.DataFrame({"check_id": frame["check_id"], "sent": [post_log(base, row, post) for row in rows]})

    return payloads.mapInPandas(run, "check_id string, sent boolean")


def unsent(sent: DataFrame) -> DataFrame:
    return sent.where(~F.col("sent"))
