"""Runs, dataset extraction, feedback and providers."""

import json

import pytest
from pyspark.sql import functions as F

from corrobora.functions import feedback as B
from corrobora.operators import benchmark as R
from corrobora.sources import models as P


def test_a_run_asks_reads_and_scores(spark):
    entries = spark.createDataFrame([("row_1", "Supported", "The claim.", "The source says so and more.", "complete", False), ("row_2", "Not supported", "Other.", "Text.", "complete", None), ("row_3", "Supported", "x", "y", "complete", True)], "id string, ground_truth string, claim_text string, source_text string, extraction_status string, needs_manual_review boolean")

    def good(prompt):
        return {"text": json.dumps({"verdict": "SUPPORTED", "source_quote": "The source says so"}), "tokens_in": 3, "tokens_out": 4, "cost_usd": 0.5}

    def bad(prompt):
        raise RuntimeError("x API request failed (503): y")

    out = R.run(entries, {"hf:a": good, "b": bad}, {"hf:a": "A", "b": "B"}, sleep=lambda s: None)
    got = {(r["entry_id"], r["provider"]): r for r in out.collect()}
    assert len(got) == 4
    one, failed = got["row_1", "hf:a"], got["row_2", "b"]
    assert (one["predicted_verdict"], one["correct"], one["quote_status"], one["model"], one["tokens_in"], one["cost_usd"]) == ("Supported", "exact", "exact", "A", 3, 0.5)
    assert got["row_2", "hf:a"]["correct"] == "wrong" and got["row_2", "hf:a"]["quote_status"] == "not-found"
    assert (failed["predicted_verdict"], failed["confidence"], failed["correct"]) == ("ERROR", 0, None) and "503" in failed["error"]
    done = spark.createDataFrame([("row_1", "hf:a", None), ("row_2", "b", "HTTP 503")], "entry_id string, provider string, error string")
    assert R.run(entries, {"hf:a": good, "b": bad}, {"hf:a": "A", "b": "B"}, done=done, sleep=lambda s: None).count() == 3


def test_dataset_extraction(spark):
    ref = '<sup class="reference"><a href="#n1">[1]</a></sup>'
    html = f'<p>A claim of the article{ref} and another claim{ref}</p><ol><li id="n1"><a href="https://s.example/">s</a></li></ol>'
    asked = spark.sparkContext.accumulator(0)

    def article(url):
        asked.add(1)
        if "gone" in url:
            raise RuntimeError("HTTP 404")
        return html

    base = "https://w.example/?title="
    rows = spark.createDataFrame([(1, f"{base}A_b", "1", 2, "supported", "", None, None), (2, f"{base}A_b", "1", 7, "x", "v2", None, None), (3, f"{base}A_b", "5", None, "x", "v2", None, None), (4, f"{base}gone", "1", 1, "x", None, None, None), (5, f"{base}whole", "1", 1, "x", None, " given ", "https://t.example/")], "row int, article_url string, citation_number string, occurrence int, ground_truth string, dataset_version string, claim_override string, url_override string")
    got = {r["id"]: r for r in R.extract_dataset(rows, article, lambda url, page: {"content": f"text of {url}"}).collect()}
    assert asked.value == 2 and len(got) == 5
    assert (got["row_1"]["claim_text"], got["row_1"]["source_url"], got["row_1"]["extraction_status"], got["row_1"]["article_title"], got["row_1"]["ground_truth"], got["row_1"]["dataset_version"]) == ("and another claim", "https://s.example/", "complete", "A b", "Supported", "v1")
    assert got["row_2"]["claim_text"] == "A claim of the article" and got["row_3"]["extraction_status"] == "claim_extraction_failed" and got["row_3"]["needs_manual_review"]
    assert got["row_4"]["extraction_status"] == "article_fetch_failed" and got["row_4"]["claim_text"] == ""
    assert (got["row_5"]["claim_text"], got["row_5"]["source_text"], got["row_5"]["extraction_status"]) == ("given", "text of https://t.example/", "complete")


def test_publication(spark):
    rows = spark.createDataFrame([("NOT SUPPORTED", 90, "contradiction"), ("NOT SUPPORTED", 95, "omission"), ("NOT SUPPORTED", 10, "contradiction"), ("SOURCE UNAVAILABLE", 99, None), ("SUPPORTED", 99, None)], "verdict string, confidence int, reason_type string")
    assert [r["priority"] for r in R.publishable(rows).orderBy("priority").collect()] == [1, 2] and R.publishable(rows, contradictions_only=True).count() == 1
    results = spark.createDataFrame([("p", "Not supported", "Not supported", 90, None), ("p", "Not supported", "Supported", 50, None), ("p", "Supported", "Not supported", 99, None), ("p", "ERROR", "Not supported", 0, "x")], "provider string, predicted_verdict string, ground_truth string, confidence int, error string")
    got = {r["threshold"]: (r["precision"], r["recall"]) for r in R.flag_precision(results, [0, 80]).collect()}
    assert got == {0: (0.5, 0.5), 80: (1.0, 0.5)}


def test_feedback(spark):
    fields = {"article_url": F.lit("https://w/A"), "article_title": F.lit("A  b"), "citation_number": F.lit("3"), "claim_text": F.lit("c <nowiki>"), "verdict": F.lit("NOT SUPPORTED"), "provider": F.lit("p"), "model": F.lit("m"), "check_id": F.lit("ab12"), "revision_id": F.lit("77")}
    title, body, empty, url = spark.range(1).select(B.section_title(F.lit(" A  b"), F.lit("3<"), F.lit("ab12")), B.section_body(fields), B.section_body({}), B.comment_url(fields, "User talk:X", "User:X/p")).first()
    assert title == "Feedback: A b [3] (check ab12)"
    assert body.split("\n")[:2] == ["{{hidden begin|title=Check details}}", "* '''Article:''' [https://w/A A b], citation [3], revision 77"] and "* '''Tool's verdict:''' NOT SUPPORTED (p, m)" in body and "<nowiki>c</nowiki>" in body and body.endswith("<!-- check: ab12 -->")
    assert empty.startswith("'''Editor's explanation:'''") and empty.endswith("<!-- check: unknown -->")
    assert url.startswith("https://en.wikipedia.org/w/index.php?title=User+talk%3AX&action=edit&section=new&preloadtitle=Feedback%3A+A+b+%5B3%5D")
    entries = {"articleUrl": "entry.1", "claimText": "entry.2", "llmQuote": "entry.PLACEHOLDER_Q"}
    assert spark.range(1).select(B.submission_url("https://f/v", entries, {"claimText": F.lit("a b"), "articleUrl": F.lit(""), "llmQuote": F.lit("q")})).first()[0] == "https://f/v?usp=pp_url&entry.2=a+b"
    assert B.submission_configured("https://f", entries) and not B.submission_configured("https://PLACEHOLDER", entries) and not B.submission_configured("https://f", {"articleUrl": "PLACEHOLDER"})
    assert [r[0] for r in spark.createDataFrame([(1400,), (59_600,), (125_000,)], "ms long").select(B.duration(F.col("ms"))).collect()] == ["1s", "1m 0s", "2m 5s"]


@pytest.mark.parametrize(("kind", "data", "usage"), [
    ("openai", {"choices": [{"message": {"content": "t"}}], "usage": {"prompt_tokens": 1, "completion_tokens": 2, "cost": 0.1}}, (1, 2, 0.1)),
    ("claude", {"content": [{"type": "thinking"}, {"type": "text", "text": "t"}], "usage": {"input_tokens": 1, "output_tokens": 2}}, (1, 2, None)),
    ("gemini", {"candidates": [{"content": {"parts": [{"text": "t"}]}}], "usageMetadata": {"promptTokenCount": 1}}, (1, 0, None)),
])
def test_providers(kind, data, usage):
    provider = P.Provider("X", "m", "https://h.example/v1", kind)
    ask = P.caller(provider, "sys", lambda url, headers, body: (200, data), "key")
    got = ask("hello")
    assert got["text"] == "t" and (got["tokens_in"], got["tokens_out"], got["cost_usd"]) == usage and provider.host == "h.example"
    with pytest.raises(RuntimeError, match=r"API request failed \(500\)"):
        P.reply(provider, 500, {"error": {"message": "no"}})
    with pytest.raises(RuntimeError, match="Invalid API response format"):
        P.reply(provider, 200, {})


def test_provider_names(spark):
    own = {"a": P.Provider("A", "m", "https://h/x", "openai")}
    assert P.resolve("hf:org/m:fast", own).model == "org/m:fast" and P.resolve("a", own).name == "A" and P.dimension(spark, own).count() == 1
    for name in ("hf:", "zzz"):
        with pytest.raises(ValueError, match="unknown"):
            P.resolve(name, own)
    with pytest.raises(RuntimeError, match="output budget"):
        P.reply(own["a"], 200, {"choices": [{"finish_reason": "length", "message": {}}]})
