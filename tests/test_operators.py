"""Operators on small tables."""

import hashlib
import io
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corrobora import cli, reports
from corrobora.operators import citations as X
from corrobora.operators import compare as C
from corrobora.operators import enrichment as N
from corrobora.operators import ensemble as E
from corrobora.operators import findings as K
from corrobora.operators import groups as G
from corrobora.operators import metrics as M
from corrobora.operators import runs as R
from corrobora.operators import wice as W
from corrobora.operators.common import latest, ready
from corrobora.operators.contains import containing
from corrobora.sources import fetch, files, replicas

RESULT = "pos long, entry_id string, provider string, model string, ground_truth string, predicted_verdict string, confidence int, latency_ms long, error string, reason_type string, source_quote string, quote_verified boolean, tokens_in int, tokens_out int"


def results(spark, rows):
    """rows: (entry, provider, predicted, truth, extra)."""
    full = [(i, e, p, f"m{i}", t, v, x.get("confidence", 50), x.get("latency", 10), x.get("error"), x.get("reason"), x.get("quote", ""), x.get("verified", False), x.get("tin"), None) for i, (e, p, v, t, x) in enumerate(rows)]
    return spark.createDataFrame(full, RESULT)


S, P, N_, U = "Supported", "Partially supported", "Not supported", "Source unavailable"


def test_metrics_tell_the_rules_apart(spark):
    rows = [("a", "p", S, S, {}), ("b", "p", S, P, {}), ("c", "p", N_, P, {}), ("d", "p", N_, N_, {}), ("e", "p", U, U, {}), ("f", "p", "ERROR", S, {"latency": 100}), ("g", "p", S, S, {"error": "HTTP 503", "latency": 0})]
    m = M.metrics_by_provider(results(spark, rows)).first()
    assert (m["total"], m["valid"], m["errors"], m["exact_matches"], m["partial_matches"]) == (7, 5, 2, 3, 1)
    assert (m["exact_accuracy"], m["lenient_accuracy"], m["supported_vs_rest_accuracy"], m["binary_accuracy"]) == (0.6, 0.8, 0.8, 0.8)
    assert m["latency_avg"] == pytest.approx(25) and m["latency_max"] == 100 and m["model"] == "m0"


def test_confidence_and_quotes(spark):
    rows = [("a", "p", S, S, {"confidence": 0, "quote": "q", "verified": True}), ("b", "p", S, S, {"confidence": 80, "quote": "q"}), ("c", "p", N_, S, {"confidence": None, "reason": "contradiction"}), ("d", "p", N_, S, {"confidence": 40, "reason": "omission", "quote": "q"})]
    m = M.metrics_by_provider(results(spark, rows)).first()
    assert (m["confidence_avg"], m["confidence_correct"], m["confidence_wrong"], m["calibration"]) == (60, 40, 20, 20)
    assert (m["quotes_eligible"], m["quotes_offered"], m["quotes_verified"], m["fidelity"]) == (3, 2, 1, 0.5)


def test_no_valid_rows_give_zeros(spark):
    m = M.metrics_by_provider(results(spark, [("a", "p", "ERROR", S, {"latency": 0})])).first()
    assert m["exact_accuracy"] == 0 and m["latency_avg"] == 0 and m["fidelity"] == 0
    assert M.metrics_by_provider(results(spark, [])).count() == 0


def test_confusion_matrix_is_whole(spark):
    rows = M.confusion_matrix(results(spark, [("a", "p", S, N_, {}), ("b", "p", "PARSE_ERROR", S, {})])).collect()
    assert len(rows) == 16 and sum(r["n"] for r in rows) == 1


def test_best_takes_the_last_of_equals(spark):
    rows = [("a", "first", S, S, {}), ("a", "second", S, S, {})]
    best = M.best(results(spark, rows)).first()
    assert best["fastest"] == "second" and best["best_calibrated"] == "second" and best["most_accurate"] == "first"
    assert [r["provider"] for r in M.ranking(results(spark, rows)).orderBy("rank").collect()] == ["first", "second"]


@pytest.fixture
def entries(spark):
    rows = [(f"row_{i}", S if i < 4 else N_, "complete", i == 6, "v1" if i % 2 else None) for i in range(7)]
    return spark.createDataFrame(rows, "id string, ground_truth string, extraction_status string, needs_manual_review boolean, dataset_version string").withColumns({"claim_text": F.col("id"), "source_url": F.lit("u"), "wice_label_projection": F.lit("mixed")})


def runs(spark):
    control = [("row_0", "a", S, S, {}), ("row_1", "a", S, S, {}), ("row_2", "a", N_, S, {}), ("row_3", "a", S, S, {}), ("row_4", "a", S, N_, {}), ("row_5", "a", S, N_, {}), ("row_6", "a", S, N_, {}), ("row_0", "b", S, S, {}), ("row_0", "a", S, S, {})]
    treatment = [("row_0", "a", S, S, {}), ("row_1", "a", N_, S, {}), ("row_2", "a", S, S, {}), ("row_3", "a", N_, S, {}), ("row_4", "a", P, N_, {}), ("row_5", "a", "supported", N_, {}), ("row_6", "a", N_, N_, {}), ("row_9", "c", S, S, {}), ("row_0", "a", S, S, {"error": "x"})]
    return results(spark, control), results(spark, treatment)


def test_compare_counts_flips_and_coverage(spark, entries):
    control, treatment = runs(spark)
    cells = C.cells(control, treatment, entries)
    s = C.provider_stats(cells).first()
    assert (s["n"], s["exact_control"], s["exact_treatment"], s["improvement"], s["regression"], s["lateral"], s["unchanged_correct"], s["unchanged_wrong_same"]) == (6, 3, 2, 1, 2, 1, 1, 1)
    assert s["exact_delta"] == pytest.approx(-100 / 6)
    assert C.coverage(control, treatment, entries).first().asDict() == {"dataset_total": 7, "dataset_valid": 6, "control_only": 1, "treatment_only": 1, "intersection": 7, "compared": 6}
    assert C.filter_cells(cells, "direction=regression").count() == 2 and C.filter_cells(cells, "version=v1").count() == 3
    with pytest.raises(ValueError, match="version, provider, direction"):
        C.filter_cells(cells, "colour=red")


def test_reports(spark, entries, tmp_path):
    control, treatment = runs(spark)
    cells = C.cells(control, treatment, entries)
    result = reports.comparison(C.provider_stats(cells), cells, C.coverage(control, treatment, entries), {"generated_at": "now", "change_axes": ["prompt"]})
    text = reports.render(result, "x.md")
    assert "| a | 6 | 50.0% | 33.3% | -16.7 |" in text and text.count("| regression |") == 2
    assert "&lt;" in reports.render_html(result | {"metadata": {"gt_version": "<v>"}}) and json.loads(reports.render(result, "x.json"))["coverage"]["compared"] == 6
    with pytest.raises(ValueError, match="report"):
        reports.render(result, "x.pdf")
    assert reports.delta_colour(5) == "#e6ffe6" and reports.delta_colour(-5) == "#ffe6e6" and reports.delta_colour(4.9) == "#f0f0f0"
    assert reports.pivot_csv([{"entry_id": "b", "x": ""}, {"entry_id": "a", "x": 'q"'}]) == '"entry_id","x"\n"a","q"""\n"b",""\n'
    assert "{{cross}} NOT SUPPORTED" in reports.wikitext([{"verdict": "NOT SUPPORTED", "citation_number": "1", "claim_text": "a|b", "comments": None}], "T")


@pytest.mark.parametrize(("votes", "plurality", "binary"), [
    ([S, S, S, N_, N_], S, S), ([S, S, N_, P], S, S), ([S, S, P, P], P, S), ([S, N_], N_, N_), ([S, P, N_, U], P, N_), ([U, "odd"], U, N_), (["odd", "ode"], "odd", N_),
])
def test_votes(spark, votes, plurality, binary):
    panel = [f"hf-{i}" for i in range(len(votes))]
    rows = results(spark, [("e", p, v, S, {}) for p, v in zip(panel, votes, strict=True)] + [("other", "hf-0", S, S, {})])
    got = E.votes(rows, panel).collect()
    assert [(r["entry_id"], r["plurality"], r["binary"]) for r in got] == [("e", plurality, binary)]


@settings(max_examples=8, deadline=None)
@given(st.permutations([S, S, P, N_, N_]))
def test_votes_do_not_depend_on_order(spark, votes):
    panel = [f"hf-{i}" for i in range(5)]
    got = E.votes(results(spark, [("e", p, v, S, {}) for p, v in zip(panel, votes, strict=True)]), panel).first()
    assert (got["plurality"], got["binary"]) == (N_, S)


def test_ensembles_are_idempotent(spark):
    panel = ["hf-a", "hf-b", "hf-c"]
    rows = results(spark, [("e", p, S, S, {"tin": 5 if p == "hf-a" else None}) for p in panel])
    names = E.panel_names(panel)
    once = E.with_votes(rows, panel, names)
    assert once.count() == 5 and E.with_votes(once, panel, names).count() == 5
    vote = once.where(F.col("provider") == "hf-vote-3").first()
    assert (vote["tokens_in"], vote["tokens_out"], vote["latency_ms"], vote["correct"]) == (5, None, 30, "exact")
    for bad in (["hf-a", "openrouter-b"], ["x-a", "x-b"]):
        with pytest.raises(ValueError, match="hf"):
            E.panel_names(bad)


def test_runs(spark, entries):
    done = results(spark, [("row_0", "a", S, S, {})])
    assert R.open_tasks(ready(entries).select(F.col("id").alias("entry_id")), ["a", "b"], done).count() == 11
    rows = results(spark, [("row_0", "a", S, S, {}), ("row_1", "a", S, S, {"error": "x"}), ("row_1", "b", S, S, {"error": "x"}), ("zz", "b", S, S, {})])
    assert R.reload(rows, ["a"], True).count() == 3 and R.reload(rows, ["a"], False).count() == 2
    assert R.of_version(rows, entries, "v1").count() == 4 and R.of_projection(rows, entries, "mixed").count() == 3
    with pytest.raises(ValueError, match="unanimous"):
        R.of_projection(rows, entries, "both")
    assert [r["id"] for r in R.by_number(entries.where("id IN ('row_2', 'row_0')")).collect()] == ["row_0", "row_2"]
    assert latest(rows, ["entry_id"], ["pos"]).count() == 3


NOTES = '<ol class="references"><li id="n1"><a href="https://a.example/">a</a>, pp. 7</li><li id="n2"><a href="#CITEREFX">X 2001</a></li><li id="n3">no link, p 3</li><li id="n4"><a href="https://archive.ph/q">q</a> <a href="https://web.archive.org/web/1/https://b.example/">w</a></li><li><cite id="CITEREFX">X</cite> <a href="https://x.example/">full</a></li></ol>'


def ref(n, i="r"):
    return f'<sup id="{i}{n}" class="reference"><a href="./T#n{n}">[{n}]</a></sup>'


def collect(spark, html):
    """Citations of one article, in order, as rows."""
    return sorted(X.extract_citations(spark.createDataFrame([("d", html)], "doc_id string, html string")).collect(), key=lambda r: r["pos"])


def test_citations_are_grouped_and_resolved(spark):
    html = f"<h2>A</h2><p>The first claim of this text{ref(1)}{ref(2)} and the second one here{ref(3)}, still more text follows{ref(4)} {ref(1, 's')}</p><h2>B</h2><p>Tiny{ref(2, 't')} but long enough as a whole.</p><p>x{ref(3, 'u')}</p>{NOTES}"
    got = collect(spark, html)
    assert [(c["citation_number"], c["group_id"], c["group_size"], c["group_index"], c["section"]) for c in got] == [("1", "r1", 2, 0, 1), ("2", "r1", 2, 1, 1), ("3", "r3", 1, 0, 1), ("4", "r4", 2, 0, 1), ("1", "r4", 2, 1, 1), ("2", "t2", 1, 0, 2)]
    assert got[0]["claim_text"] == got[1]["claim_text"] == "The first claim of this text" and got[2]["claim_text"] == "and the second one here" and got[3]["claim_text"] == ", still more text follows"
    assert got[5]["claim_text"] == "Tiny but long enough as a whole."
    assert [c["url"] for c in got[:4]] == ["https://a.example/", "https://x.example/", None, "https://web.archive.org/web/1/https://b.example/"]
    assert [c["page_num"] for c in got[:4]] == [7, None, 3, None] and [c["occurrence"] for c in got] == [1, 1, 1, 1, 2, 2]
    assert got[0]["group_citation_numbers"] == ["1", "2"]


def test_citations_of_odd_pages(spark):
    assert collect(spark, "") == [] and collect(spark, "<p>no refs") == []
    assert collect(spark, f"<span>Outside of any container{ref(1)}</span>{NOTES}") == []
    assert collect(spark, '<p>Named without a fragment<sup class="reference"><a href="x">[1]</a></sup></p>') == []
    got = collect(spark, f"<ul><li>One item of a list{ref(1)}<li>Another item here[dubious\xa0– discuss]{ref(1, 'z')}</ul>")
    assert [c["claim_text"] for c in got] == ["One item of a list", "Another item here"] and got[1]["url"] is None


def test_citation_occurrences(spark):
    frame = spark.createDataFrame([("d", f"<p>A claim that is long{ref(1)} and another claim{ref(1, 's')}</p>{NOTES}"), ("e", None)], "doc_id string, html string")
    rows = X.extract_citations(frame)
    assert X.by_number(rows, "1", 2).first()["claim_text"] == "and another claim" and X.by_number(rows, "1", 9).first()["occurrence"] == 1


def test_enrichment_end_to_end(spark):
    pages = {"Good": f"<p>The claim of this article{ref(1)} and a second claim{ref(3)}</p>{NOTES}", "Empty": "<p>none</p>"}
    candidates = spark.createDataFrame([(1, "Good", 10), (2, "Empty", 11), (3, "Gone", 12)], "page_id long, title string, revision_id long")

    def article(title, revision):
        if title not in pages:
            raise RuntimeError("HTTP 404")
        return {"html": pages[title], "status": 200}

    def source(url, page):
        return fetch.shape_reply("The claim of this article is true. " * 5, source_url=url, page=page, truncated=True)

    articles, citations = N.process(candidates, article, source)
    assert {r["title"]: (r["outcome"], r["citations"]) for r in articles.collect()} == {"Good": ("ok", 2), "Empty": ("no_citations", 0), "Gone": ("fetch_failed", 0)}
    verdicts = N.verify(citations, lambda prompt: json.dumps({"verdict": "SUPPORTED", "confidence": 80, "source_quote": "The claim of this article is true."}))
    got = {r["citation_number"]: r for r in verdicts.collect()}
    assert (got["1"]["verdict"], got["1"]["quote_status"], got["1"]["truncated"]) == ("SUPPORTED", "exact", True)
    assert (got["3"]["verdict"], got["3"]["confidence"], got["3"]["unavailable_reason"]) == ("SOURCE UNAVAILABLE", 0, "no_url")

    def broken(prompt):
        raise RuntimeError("API request failed (500)")

    assert N.verify(citations, broken).where("citation_number = '1'").first()["verdict"] == "ERROR"
    assert N.extraction_totals(citations).first().asDict() == {"citations": 2, "with_url": 1, "fetched": 1, "failed": 0, "sources": 1}
    found = N.as_findings(verdicts, "enwiki", "p", "1")
    first = K.upsert(found.limit(0), found, K.KEY, ["pos"])
    assert first.count() == 2 and K.upsert(first, found, K.KEY, ["pos"]).count() == 2


def test_sources_are_fetched_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def source(url, page):
        calls.add(1)
        if "bad" in url:
            raise RuntimeError("HTTP 500")
        return {"content": "c", "status": 200}

    rows = spark.createDataFrame([("https://a/", 1)] * 20 + [("https://a/", None), ("https://bad/", None), (None, None)], "url string, page_num int")
    got = fetch.resolve_sources(rows, source).collect()
    assert calls.value == 3 and len(got) == 23
    assert {(r["url"], r["unavailable_reason"], r["error"]) for r in got} == {("https://a/", None, None), ("https://bad/", "fetch_failed", "HTTP 500"), (None, "no_url", None)}


def test_fetch_rules():
    seen = []
    proxy = lambda url, page: seen.append(url) or {"content": None if "live" in url else "x", "error": None}
    assert "skipped" in fetch.fetch_source("https://books.google.com/x", None, proxy)["error"] and not seen
    fetch.fetch_source("https://web.archive.org/web/1/https://a/", None, proxy)
    assert seen == ["https://web.archive.org/web/1id_/https://a/"]
    assert fetch.fetch_source("https://live/", None, proxy, lambda u: "kept")["content"] == "x"
    assert fetch.shape_reply("short")["content"] is None and "Truncated: true" in fetch.shape_reply("x" * 12_000)["content"]
    tries = []
    with pytest.raises(RuntimeError):
        fetch.with_retry(lambda: tries.append(1) or (_ for _ in ()).throw(RuntimeError("HTTP 503 x")), tries=3, sleep=lambda s: None)
    assert len(tries) == 3
    assert fetch.is_retryable("Foo API request failed (429): x") and fetch.is_retryable("socket hang up") and not fetch.is_retryable("HTTP 404") and not fetch.is_retryable("said HTTP 500")
    assert [fetch.exit_code(m) for m in ("x (404)", "x (500)", "boom", "Invalid API response format")] == [9, 10, 10, 11]


def test_groups(spark):
    rows = spark.createDataFrame([(0, None, 1, "SUPPORTED"), (1, "g", 2, "NOT SUPPORTED"), (2, "h", 2, "SUPPORTED"), (3, "g", 2, "SUPPORTED"), (4, "h", 2, "odd"), (5, "i", 2, "SUPPORTED")], "pos long, group_id string, group_size int, verdict string")
    judged = spark.createDataFrame([("g", False, "PARTIALLY SUPPORTED"), ("h", True, None)], "group_id string, skipped boolean, verdict string")
    units = G.report_units(rows, judged)
    assert [(r["at"], r["pos"], r["kind"], r["verdict"]) for r in units.orderBy("at", "pos").collect()] == [(0, 0, "solo", "SUPPORTED"), (1, 1, "group", "PARTIALLY SUPPORTED"), (2, 2, "member", "SUPPORTED"), (2, 4, "member", "odd")]
    assert {r["bucket"]: (r["units"], r["citations"]) for r in G.report_counts(units).collect()} == {"supported": (2, 2), "partial": (1, 2), "error": (1, 1)}
    assert G.visible(units).count() == 2
    members = spark.createDataFrame([("g", 0, "1", "u", 2, "Source Content:\n text ", None, None), ("g", 1, "2", "u", 2, "x", None, None), ("g", 2, "3", None, None, None, None, "No URL"), ("g", 3, "4", "v", None, None, 404, None)], "group_id string, group_index int, citation_number string, url string, page_num int, content string, status int, error string")
    got = G.assemble(members).first()
    assert got["text"] == "Source [1][2] (u):\ntext\n\nSource [3]:\n[This source could not be retrieved: No URL]\n\nSource [4] (v):\n[This source could not be retrieved: HTTP 404]"
    assert (got["sources"], got["available"], got["skipped"]) == (3, 1, True)


def test_wice(spark):
    claims = spark.createDataFrame(
        [("c1", "partially_supported", "Claim.", ["(meta data) TITLE: My title", "(meta data) PUBLISHER:  ", "One two", "Three"], [[3, 1], [1]], "A b (c)", "", "Before."), ("c2", "supported", "X", None, None, None, None, None)],
        "id string, label string, claim string, evidence array<string>, supporting_sentences array<array<int>>, claim_title string, claim_section string, claim_context string",
    )
    subs = spark.createDataFrame([(1, "c1-1", "b"), (0, "c1-0", "a"), (0, None, "z")], "pos int, id string, label string")
    got = {r["wice_id"]: r for r in W.convert(claims, subs, "dev", 33).collect()}
    one = got["c1"]
    assert one["source_text"] == "TITLE: My title PUBLISHER:   One two"[:25].strip() + " " * 0 or one["source_text"].startswith("TITLE: My title")
    assert one["article_url"] == "https://en.wikipedia.org/wiki/A_b_(c)" and one["ground_truth"] == "Partially supported" and one["claim_container"] == "Before. Claim."
    assert one["wice_subclaim_labels"] == ["a", "b"] and one["wice_label_projection"] == "mixed" and one["wice_supporting_sentences"] == [1, 3] and one["needs_manual_review"] and one["source_title"] == "My title" and one["source_publisher"] is None
    two = got["c2"]
    assert two["wice_label_projection"] == "unknown" and two["source_text"] == "" and not two["wice_source_truncated"] and two["article_url"] is None
    assert {(r["tally"], r["value"]): r["n"] for r in W.summary(W.convert(claims, subs, "dev")).collect()}[("total", "all")] == 2


def test_containment_matches_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(80)]
    quotes = [(i, texts[rng.randrange(80)][1][rng.randrange(3) :][: rng.randrange(1, 60)]) for i in range(60)] + [(99, "")]
    got = containing(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(quotes, "item_id long, quote string"))
    assert sorted(map(tuple, got.collect())) == sorted((d, i) for d, t in texts for i, q in quotes if q and q in t)


def test_upsert_keeps_creation_and_nulls_meet(spark):
    old = spark.createDataFrame([(1, None, "a", 5), (2, "x", "b", 6)], "k int, l string, v string, created_at int")
    new = spark.createDataFrame([(1, None, "c", 9), (1, None, "d", 10), (3, "y", "e", 11)], "k int, l string, v string, created_at int")
    got = K.upsert(old, new, ["k", "l"], ["created_at"])
    assert sorted(map(tuple, got.collect())) == [(1, None, "d", 5), (2, "x", "b", 6), (3, "y", "e", 11)]
    assert sorted(map(tuple, K.upsert(got, new, ["k", "l"], ["created_at"]).collect())) == sorted(map(tuple, got.collect()))
    with pytest.raises(ValueError, match="known"):
        K.criterion("nope")


def test_files(spark, tmp_path):
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string("a int, b string")
    for name, body in (("bare", [{"a": 1, "b": "x"}]), ("wrapped", {"metadata": {"run_at": "t"}, "rows": [{"a": 1, "b": "x"}]}), ("neither", {"x": 1})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=1))
    read = lambda n: [tuple(r) for r in files.read_rows(spark, f"{tmp_path}/{n}.json", schema).collect()]
    assert read("bare") == read("wrapped") == [(1, "x")] and read("neither") == []
    meta = _parse_datatype_string("run_at string")
    assert files.read_metadata(spark, f"{tmp_path}/wrapped.json", meta).first()[0] == "t" and files.read_metadata(spark, f"{tmp_path}/bare.json", meta).count() == 0
    (tmp_path / "t.csv").write_text('h1,h2, h3\n a ,"b ""c"", d"\n\nx\n')
    assert [tuple(r) for r in files.read_csv(spark, f"{tmp_path}/t.csv", compatible=True).collect()] == [("a", "b c, d", "", 1), ("x", "", "", 3)]
    assert files.read_csv(spark, f"{tmp_path}/t.csv").first()[1] == 'b "c", d'
    assert files.read_log(spark, f"{tmp_path}/none.ndjson").count() == 0
    files.write_rows(spark.createDataFrame([(1, "é")], schema), f"{tmp_path}/out.json", {"k": 1})
    assert json.loads((tmp_path / "out.json").read_text()) == {"metadata": {"k": 1}, "rows": [{"a": 1, "b": "é"}]}
    frame = spark.createDataFrame([(1, "x"), (2, None)], schema)
    assert files.checksum(frame, ["a"]).first() == files.checksum(frame.orderBy(F.desc("a")).repartition(3), ["a"]).first()
    review = spark.createDataFrame([("row_1", 'say "x"', "t" * 300)], "id string, claim_text string, source_text string").withColumn("dataset_version", F.lit(None).cast("string"))
    row = files.review_table(review).first()
    assert row["claim_text"] == '"say ""x"""' and row["source_text_preview"] == '"' + "t" * 200 + '..."' and row["dataset_version"] == "v1"


def test_replicas():
    assert replicas.host_name("enwiki", "web").startswith("enwiki.web.") and replicas.database_name("enwiki") == "enwiki_p"
    assert replicas.credentials("# c\n[client]\nuser = 'u'\npassword=\"p\"\n") == {"user": "u", "password": "p"}
    for bad in (lambda: replicas.credentials("[client]\nuser=u\n"), lambda: replicas.host_name("x", "moon")):
        with pytest.raises(ValueError):
            bad()


def test_cli(spark, tmp_path):
    def write(name, rows):
        (tmp_path / name).write_text(json.dumps({"metadata": {}, "rows": rows}))
        return str(tmp_path / name)

    entry = lambda i, v: {"entry_id": f"row_{i}", "provider": "hf-a", "model": "m", "ground_truth": S, "predicted_verdict": v, "latency_ms": 5, "confidence": 50}
    a, b = write("a.json", [entry(1, S), entry(2, N_)]), write("b.json", [entry(1, N_), entry(2, S)])
    data = write("d.json", [{"id": f"row_{i}", "ground_truth": S, "extraction_status": "complete", "needs_manual_review": False, "claim_text": "c", "source_url": "u"} for i in (1, 2)])
    out = io.StringIO()
    assert cli.main(["compare", a, b, "--dataset", data, "--report", str(tmp_path / "r.html"), "--filter", "direction=regression"], spark, out) == 0
    assert "| row_1 |" in out.getvalue() and "| row_2 |" not in out.getvalue() and (tmp_path / "r.html").read_text().startswith("<!DOCTYPE")
    assert cli.main(["analyze", "--results", a, "--dataset", data, "--version", "v1"], spark, out) == 0 and "50.0%" in out.getvalue()
    assert cli.main(["inspect", "--results", a, "--dataset", data], spark, out) == 0 and "row_2: Not supported" in out.getvalue()
    assert cli.main(["compare", a, write("e.json", []), "--dataset", data], spark, out) == 2
    panel = [entry(1, v) | {"provider": p} for p, v in zip(E.PANELS["hf"], (S, S, N_), strict=True)]
    path = write("p.json", panel)
    assert cli.main(["ensemble", "--results", path, "--write"], spark, out) == 0 and len(json.loads((tmp_path / "p.json").read_text())["rows"]) == 5


def test_ordered_checksum(spark):
    def sequential(rows, fan):
        level = [hashlib.sha256(json.dumps(dict(zip(("a", "b"), r, strict=True)), separators=(",", ":")).encode()).hexdigest() for r in rows]
        while True:
            level = [hashlib.sha256("".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
            if len(level) <= 1:
                return level[0] if level else hashlib.sha256(b"").hexdigest()

    def found(rows, order=("a",), fan=4):
        return files.ordered_checksum(spark.createDataFrame(rows, "a int, b string").repartition(3), order, fan).first()["checksum"]

    rows = [(None, "x"), *((i, f"t{i}" if i % 3 else None) for i in range(50))]
    assert found(rows) == found(rows[::-1]) == sequential(rows, 4) and found([]) == sequential([], 4) and found(rows[:1]) == sequential(rows[:1], 4)
    moved = [*rows[:10], (9, "t10"), (10, None), *rows[12:]]  # two rows have changed places
    assert found(moved) == sequential(moved, 4) != sequential(rows, 4)
    assert found([(1, "a")] * 20) == sequential([(1, "a")] * 20, 4)


@pytest.mark.parametrize(("rows", "most", "asked"), [(10, 100, [(0, 4), (4, 4), (8, 4)]), (10, 6, [(0, 4), (4, 2)]), (8, 100, [(0, 4), (4, 4), (8, 4)]), (0, 5, [(0, 4)])])
def test_pages_end_with_a_short_one(spark, rows, most, asked):
    seen = []

    def read(after, limit):
        seen.append((after, limit))
        return spark.range(1, rows + 1).select(F.col("id").alias("page_id")).where(F.col("page_id") > after).orderBy("page_id").limit(limit)

    assert sorted(r[0] for r in K.all_candidates(read, most, 4).collect()) == list(range(1, min(rows, most) + 1)) and seen == asked
    with pytest.raises(ValueError, match="did not pass"):
        K.all_candidates(lambda after, limit: spark.range(1, limit + 1).select(F.col("id").alias("page_id")), 9, 4)
