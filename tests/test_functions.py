"""Functions over text, verdicts, addresses, quotes and replies."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corrobora.functions import quotes as Q
from corrobora.functions import replies as P
from corrobora.functions import text as T
from corrobora.functions import urls as U
from corrobora.functions import verdicts as V


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def of(spark, f, values, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in frame.select("i", f("v").alias("o")).orderBy("i").collect()]


def test_verdict_labels(spark):
    said = ["NOT SUPPORTED", "not_supported", " Partially  supported", "SUPPORTED", "unavailable", "Source unavailable", "maybe", "", None, "PARSE_ERROR"]
    assert of(spark, V.canonical, said) == ["NOT SUPPORTED", "NOT SUPPORTED", "PARTIALLY SUPPORTED", "SUPPORTED", "SOURCE UNAVAILABLE", "SOURCE UNAVAILABLE", None, None, None, None]
    assert of(spark, V.metric_label, said)[-4:] == ["Unknown", "Unknown", "Unknown", "Error"]
    assert of(spark, V.compare_label, said)[-4:] == ["maybe", "", "", "parse_error"]
    assert of(spark, V.runner_label, said)[-3:] == ["PARSE_ERROR"] * 3
    assert of(spark, V.truth_label, said)[-4:] == ["maybe", "", None, "PARSE_ERROR"]


@pytest.mark.parametrize(("a", "b", "kind"), [("Supported", "supported", "exact"), ("Supported", "Partially supported", "partial"), ("Not supported", "Supported", "wrong"), ("x", "X", "exact"), (None, "", "exact"), ("Source unavailable", "unavailable", "exact")])
def test_match_kind(spark, a, b, kind):
    assert one(spark, V.match_kind(F.lit(a), F.lit(b))) == (kind,)


@pytest.mark.parametrize(("control", "treatment", "truth", "moved"), [
    ("support", "not", "Supported", "regression"), ("not", "support", "Supported", "improvement"), ("support", "SUPPORTED", "Supported", "unchanged-correct"), ("not", "partial", "Supported", "lateral"), ("not", "NOT_SUPPORTED", "Supported", "unchanged-wrong-same"),
])
def test_direction(spark, control, treatment, truth, moved):
    assert one(spark, V.direction(F.lit(control), F.lit(treatment), F.lit(truth))) == (moved,)


def test_quote_expected_and_action(spark):
    rows = [("SUPPORTED", None), ("Partially supported", "x"), ("NOT SUPPORTED", "contradiction"), ("NOT SUPPORTED", "omission"), ("SOURCE UNAVAILABLE", "contradiction"), (None, None)]
    frame = spark.createDataFrame(rows, "v string, r string")
    assert [tuple(r) for r in frame.select(V.quote_expected("v", "r"), V.needs_action("v")).collect()] == [(True, False), (True, True), (True, True), (False, True), (False, True), (False, False)]


def test_text_cleaning(spark):
    assert of(spark, T.collapse, ["  a b  c\n", "", None]) == ["a b c", "", None]
    assert one(spark, T.clean_claim(F.lit("The claim is here[1][2] [citation needed] and there.[failed verification]"), F.lit("box"))) == ("The claim is here and there.",)
    assert one(spark, T.clean_claim(F.lit("short[1]"), F.lit("The whole container [3] is used."))) == ("The whole container is used.",)
    assert of(spark, T.truncate_for_log, [" a ", " ", None, "x" * 2001]) == ["a", None, None, "x" * 1999 + "…"]
    assert of(spark, T.revision_id, ["12", " 12 ", "0", "-1", "1.5", "9007199254740992", "x", None]) == [12, 12, None, None, None, None, None, None]
    assert of(spark, T.source_text, ["Manual source text:\n\n body", "Source URL: x\n\nSource Content:\nthe\nbody", "bare"]) == ["body", "the\nbody", "bare"]
    assert of(spark, T.escape_html, ["<a href='x'>&\"", None]) == ["&lt;a href=&#39;x&#39;&gt;&amp;&quot;", ""]
    assert of(spark, T.nowiki, [" a <nowiki>b</nowiki>\nc ", "< / NOWIKI >", None]) == ["<nowiki>a b c</nowiki>", "", ""]
    assert of(spark, T.wikitable_cell, ["a|b\nc", None]) == ["a{{!}}b c", ""]
    assert len(one(spark, T.check_id())[0]) == 8
    assert one(spark, F.hex(T.claim_hash(F.lit(None).cast("string"))))[0].lower() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_html_text(spark):
    body = "word " * 40
    pages = [f"<html><body><p>{body}</p><script>x</script></body></html>", "<body>short</body>", f"<main>{body}</main><article>{body}A</article>", None]
    out = of(spark, T.html_text, pages)
    assert out[0] == body.strip() and out[1] is None and out[2] == body + "A" and out[3] is None


def test_urls(spark):
    assert of(spark, U.page_number, ["p. 12", "pp 3-9", "Page 7", "ép. 42", "step 3", None, "pages 5"]) == [12, 3, 7, 42, None, None, 5]
    assert of(spark, U.fragment, ["./T#cite_note-1", "#", "x", None]) == ["cite_note-1", None, None, None]
    assert one(spark, U.archive_parts(F.lit("https://web.archive.org/web/2020id_/https://a.b/c")))[0].asDict() == {"timestamp": "2020", "original_url": "https://a.b/c"}
    live, dead, wiki = "https://a.example/", "https://archive.ph/x", "https://en.wikipedia.org/wiki/X"
    wayback = "https://web.archive.org/web/1/https://a.example/"
    assert of(spark, U.footnote_url, [[dead, live], [live, wayback], [dead], [wiki], ["/x"], []], "array<string>") == [live, wayback, dead, None, None, None]
    assert of(spark, U.dataset_url, [[live, dead], [wiki, live], [wiki], []], "array<string>") == [dead, live, wiki, None]
    assert of(spark, U.encode_component, ["a b/(c)!'*~é"]) == ["a%20b%2F(c)!'*~%C3%A9"]
    assert one(spark, U.rest_url(F.lit("A b/c"), F.lit(7))) == ("https://en.wikipedia.org/api/rest_v1/page/html/A_b%2Fc/7",)
    assert of(spark, U.wiki_title, ["https://x.org/w/index.php?title=A_b&oldid=3", "https://x.org/wiki/C%20d", "https://x.org/"]) == ["A b", "C d", None]
    assert of(spark, U.host, ["HTTPS://u@A.b:8/x?y", "x", None]) == ["a.b", "", ""]
    assert one(spark, U.source_key(F.lit("u"), F.lit(0)), U.source_key(F.lit("u"), F.lit(3))) == ("u", "u|page=3")
    assert one(spark, U.query_url("https://f/x", [("usp", F.lit("a b")), ("e.1", F.lit("")), ("e.2", F.lit("ü"))])) == ("https://f/x?usp=a+b&e.2=%C3%BC",)


SOURCE = "The mall&#8217;s amusement park opened in 1992 and closed in 2005, officials said. It was a school-\nlike building near the ﬁrst station. José Müller &amp; Sons built it."
CASES = [
    (SOURCE, "opened in 1992 and closed in 2005", "exact"), (SOURCE, "“opened in 1992 and closed in 2005”", "exact"), (SOURCE, "the mall's amusement park opened", "normalized"), (SOURCE, "It was a school-like building", "normalized"),
    (SOURCE, "near the first station", "normalized"), (SOURCE, "José Müller & Sons built it", "normalized"), (SOURCE, "amusement park opened … It was a school-like building", "normalized"), (SOURCE, "It was a school-like building ... amusement park opened", "partial"),
    (SOURCE, "amusement park opened in 1992 [...] in 2005", "normalized"), (SOURCE, "closed in 2005, officials said;", "normalized"), (SOURCE, "this was never in the source at all", "not-found"), (SOURCE, "short", "too-short"),
    (SOURCE, "  ", "empty"), (SOURCE, None, "empty"), ("  ", "a quote that is long", "no-source"), (None, "a quote that is long", "no-source"), (SOURCE, "amuse ment park opened in", "not-found"), ("a &bogus; b &#xD800; text here", "a &bogus; b &#xd800; text", "normalized"),
]


@pytest.mark.parametrize(("source", "quote", "status"), CASES)
def test_quote_status(source, quote, status):
    got = Q.verify(source, quote)
    assert got["status"] == status and got["verified"] == (status in ("exact", "normalized"))


def test_quotes_in_spark(spark):
    frame = spark.createDataFrame([(s, q) for s, q, _ in CASES], "s string, q string")
    assert [r[0] for r in frame.select(Q.check("s", "q")["status"]).collect()] == [c[2] for c in CASES]


def test_quote_segments():
    got = Q.verify(SOURCE, "amusement park opened in 1992 … invented words of no source … in 2005")
    assert [(s["found"], s["located"]) for s in got["segments"]] == [(True, True), (False, False), (True, True)] and got["status"] == "partial"
    assert got["verified_text"] == "amusement park opened in 1992 … in 2005"


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60), st.text(max_size=40))
def test_quote_status_is_total(source, quote):
    assert Q.verify(source, quote)["status"] in V.QUOTE_STATUSES


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcdefgh ijkl", min_size=20, max_size=60))
def test_every_part_of_a_source_is_found(source):
    part = source[3:18]
    assert Q.verify(source, part)["status"] in ("exact", "normalized", "too-short", "empty", "no-source")


REPLIES = [
    ('{"verdict": "SUPPORTED", "confidence": 90, "comments": "ok", "source_quote": " q "}', ("SUPPORTED", 90, "ok", None, "q")), ('text ```json\n{"verdict": "NOT SUPPORTED", "quote": "x"}\n``` more', ("NOT SUPPORTED", None, "", None, "x")),
    ('I say {"verdict": "PARTIALLY SUPPORTED", "reason_type": "omission", "sourceQuote": 3} so', ("PARTIALLY SUPPORTED", None, "", "omission", "")), ("**Verdict:** Not supported because", ("NOT SUPPORTED", None, "<extracted from non-JSON response>", None, "")),
    ("nothing here", ("PARSE_ERROR", None, "Failed to parse AI response: nothing here", None, "")), ('{"confidence": 0}', ("UNKNOWN", 0, "", None, "")), ('{"verdict": "SUPPORTED", "verdict": "NOT SUPPORTED"}', ("NOT SUPPORTED", None, "", None, "")), (None, ("PARSE_ERROR", None, "Failed to parse AI response: ", None, "")),
]


def test_replies(spark):
    frame = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(REPLIES)], "i int, r string")
    assert [tuple(r["p"]) for r in frame.select("i", P.parsed("r").alias("p")).orderBy("i").collect()] == [w for _, w in REPLIES]


def test_java_and_re2_agree_on_white_space(spark):
    chars = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2003, 0x200B, 0x2028, 0x202F, 0x205F, 0x3000, 0xFEFF]))
    ours = one(spark, F.regexp_replace(F.lit(chars), f"[{T.JS_SPACE}]", "_"))[0]
    theirs = duckdb.connect().execute(f"SELECT regexp_replace(?, '[{T.JS_SPACE_RE2}]', '_', 'g')", [chars]).fetchall()[0][0]
    assert ours == theirs and ours.count("_") == len(chars) - 2


def test_settled_quotes_equal_the_sequential_check(spark):
    from corrobora.functions import quotes as Q

    source = "It was said: “The bridge opened in 1932, as planned.” Café & bar &amp; more words here. \"whole quoted words\""
    pairs = [(s, q) for s in (None, "", " \n", source) for q in (
        None, "", "  ", "short", "The bridge opened", " The bridge opened in 1932 ", '"whole quoted words"', "“The bridge opened in 1932, as planned.”", "bar &amp; more words here", "Café & bar &amp; more",
        "éééééé", "THE BRIDGE ... more words here", "nothing like this at all", "the bridge opened ... nothing like this")]
    rows = spark.createDataFrame([(i, s, q) for i, (s, q) in enumerate(pairs)], "i int, s string, q string").select("i", Q.check("s", "q").alias("r")).orderBy("i").collect()
    for row, (s, q) in zip(rows, pairs, strict=True):
        assert row["r"].asDict(recursive=True) == Q.verify(s, q), (s, q)


def test_quotes_on_one_source_normalise_it_once(monkeypatch):
    from corrobora.functions import quotes as Q

    own, seen = Q.normalize, []
    monkeypatch.setattr(Q, "normalize", lambda text: seen.append(text) or own(text))
    source = "A long source, \u201cread\u201d by   many quotes that follow each other. " * 3
    found = [Q.verify(source, q)["status"] for q in ("A LONG SOURCE, 'READ' BY MANY", "quotes that ... nowhere in any text", "READ' BY MANY QUOTES - not there")]
    assert found == ["normalized", "partial", "not-found"] and seen.count(source) == 1


def test_the_comparable_form_is_that_of_its_definition():
    """Replacements by single characters give what one pass over a table and two regular expressions give."""
    import random
    import re
    import unicodedata

    from corrobora.functions import quotes as Q

    def defined(text):
        out = Q.decode_entities(unicodedata.normalize("NFKC", text)).translate(Q._FOLD)
        out = re.sub(f"{Q._SPACE}+", " ", re.sub(f"-{Q._SPACE}+", "-", out))
        return re.sub(f"^{Q._SPACE}+|{Q._SPACE}+$", "", out).lower()

    rng, letters = random.Random(4), "ab .-\u2013\u2014\u2011\u2026'`\u2019\u201c\u00ab\t\n\u2028\x85\u00a0\u3000\u200b\ufeff\ufb01\u00c9\u0130\u03a3[]"
    for _ in range(5_000):
        text = "".join(rng.choice([*letters, "&amp;", "&nbsp;", "&#8230;"]) for _ in range(rng.randrange(30)))
        assert Q.normalize(text) == defined(text)


def test_quotes_on_spark_are_those_of_the_helper(spark):
    from corrobora.functions import quotes as Q

    text = "Plain words, 'quoted' and dashed \u2013 once; then more. \x85"
    rows = [(i, s, q) for i, (s, q) in enumerate((s, q) for s in (text, "", " \x85", "\u2028 ", None) for q in (text, text.upper(), "", None, "\x85", " words, 'quoted' and \u2028", "1 2 3 4", "Plain words ... more. \x85 ", "\u201cPlain words, \"quoted\" AND\u201d"))]
    frame = spark.createDataFrame(rows, "id int, s string, q string")
    got = {r["id"]: r["c"].asDict(recursive=True) for r in frame.select("id", Q.check("s", "q").alias("c")).collect()}
    assert got == {i: Q.verify(s, q) for i, s, q in rows}


def test_composition_holds_few_texts_at_a_time(spark):
    import tracemalloc

    import pyarrow as pa

    text = "Cafe\u0301 " * 4_000
    batch = pa.array([text] * 1_000)  # 28 million characters
    tracemalloc.start()
    (out,) = T._composed.func(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000 and out[999].as_py() == "Caf\u00e9 " * 4_000
    rows = spark.createDataFrame([("e\u0301",), ("\u00e9 \u024f",), ("plain",), ("",), (None,), ("\u1100\u1161",)], "t string")
    assert [r[0] for r in rows.select(T.nfc("t")).collect()] == ["\u00e9", "\u00e9 \u024f", "plain", "", None, "\uac00"]
