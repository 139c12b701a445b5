"""Model replies read as verdicts."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, T.IntegerType() if n == "confidence" else T.StringType()) for n in ("verdict", "confidence", "comments", "reason_type", "source_quote")])
_FENCE = re.compile(r"```(?:json)?\s*([\s\S]*?)\s*```")
_PROSE = re.compile(r"verdict[\s:\"']+([A-Z][A-Z _]*)", re.I)
_PREFIXES = [("NOT", "NOT SUPPORTED"), ("PARTIAL", "PARTIALLY SUPPORTED"), ("UNAVAIL", "SOURCE UNAVAILABLE"), ("SOURCE", "SOURCE UNAVAILABLE"), ("SUPPORT", "SUPPORTED")]


def _no_constant(name: str):
    raise ValueError(name)


def parse(reply: str | None) -> dict:
    """The verdict in a JSON reply (bare, fenced or inside prose), else one named in prose, else PARSE_ERROR."""
    reply = reply or ""
    text = reply.strip()
    if fence := _FENCE.search(text):
        body = fence[1].strip()
    else:
        body = text[text.find("{") : text.rfind("}") + 1] if "{" in text and "}" in text[text.find("{") :] else text
    try:
        got = json.loads(body, parse_constant=_no_constant)
        if not isinstance(got, dict):
            raise ValueError("not an object") if got is None else TypeError
        quote = next((got[k] for k in ("source_quote", "sourceQuote", "quote") if got.get(k) is not None), None)
        confidence = got.get("confidence")
        return {
            "verdict": str(got.get("verdict") or "UNKNOWN"),
            "confidence": int(confidence) if isinstance(confidence, (int, float)) and not isinstance(confidence, bool) else None,
            "comments": str(got.get("comments") or ""),
            "reason_type": got.get("reason_type") or None,
            "source_quote": quote.strip() if isinstance(quote, str) else "",
        }
    except TypeError:
        return {"verdict": "UNKNOWN", "confidence": None, "comments": "", "reason_type": None, "source_quote": ""}
    except ValueError:
        pass
    if named := _PROSE.search(re.sub(r"\*+|__+", "", text)):
        word = re.sub(r"\s+", " ", named[1].upper().replace("_", " ")).strip()
        for prefix, verdict in _PREFIXES:
            if word.startswith(prefix):
                return {"verdict": verdict, "confidence": None, "comments": "<extracted from non-JSON response>", "reason_type": None, "source_quote": ""}
    return {"verdict": "PARSE_ERROR", "confidence": None, "comments": f"Failed to parse AI response: {reply[:200]}", "reason_type": None, "source_quote": ""}


@F.pandas_udf(SCHEMA)
def parsed(replies: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([parse(x) for x in replies], columns=["verdict", "confidence", "comments", "reason_type", "source_quote"])
    return out.astype({"confidence": "Int32"})
