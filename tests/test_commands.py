"""Commands that take injected callables."""

import io
import json

from corrobora import cli

REF = '<sup class="reference"><a href="#n1">[1]</a></sup><sup class="reference"><a href="#n2">[2]</a></sup>'
HTML = f'<p>The claim of the article{REF}</p><ol><li id="n1"><a href="https://s.example/">s</a></li><li id="n2">none</li></ol>'


def article(title, revision=None):
    return {"html": HTML, "status": 200} if "Gone" not in title else {"html": None, "status": 404}


def page(url):
    return HTML


def source(url, number):
    return {"content": "Source URL: x\n\nSource Content:\nThe claim of the article is true."}


def model(prompt):
    return json.dumps({"verdict": "SUPPORTED", "confidence": 9, "source_quote": "The claim of the article"})


def broken(prompt):
    raise RuntimeError("X API request failed (429): slow down")


def models():
    return {"a": lambda prompt: {"text": model(prompt)}}


def changes(wiki, start, end, token):
    if wiki == "bad":
        raise RuntimeError("HTTP 500")
    return [{"revid": i, "timestamp": end, "comment": "by the Tool"} for i in (1, 2)], None


HERE = "tests.test_commands:"


def call(spark, *argv):
    out = io.StringIO()
    return cli.main([str(a) for a in argv], spark, out), out.getvalue()


def test_verify(spark):
    inject = ["--article", HERE + "article", "--source", HERE + "source", "--model", HERE + "model"]
    code, said = call(spark, "verify", "https://en.wikipedia.org/wiki/Foo", "1", *inject)
    assert code == 0 and "Verdict: SUPPORTED (9)" in said and "Quote: exact" in said
    assert [call(spark, "verify", u, n, *inject)[0] for u, n in (("https://x/", "1"), ("https://x/wiki/Gone", "1"), ("https://x/wiki/A", "7"), ("https://x/wiki/A", "2"))] == [2, 3, 5, 6]
    assert call(spark, "verify", "https://x/wiki/A", "1", *inject[:5], HERE + "broken")[0] == 9


def test_run_and_resume(spark, tmp_path):
    data = tmp_path / "d.json"
    data.write_text(json.dumps([{"id": f"row_{i}", "ground_truth": "Supported", "extraction_status": "complete", "claim_text": "c", "source_text": "The claim of the article."} for i in (1, 2, 3)]))
    path = tmp_path / "r.json"
    assert call(spark, "run", "--dataset", data, "--results", path, "--models", HERE + "models", "--limit", 2) == (0, "a: 2/2 exact, 0 partial, 0 wrong, 0 errors\n")
    assert call(spark, "run", "--dataset", data, "--results", path, "--models", HERE + "models", "--resume") == (0, "a: 1/1 exact, 0 partial, 0 wrong, 0 errors\n")
    assert len(json.loads(path.read_text())["rows"]) == 3
    assert call(spark, "run", "--dataset", data, "--results", path, "--models", HERE + "models", "--providers", "zz")[0] == 2


def test_extract(spark, tmp_path):
    table = tmp_path / "t.csv"
    table.write_text("Article URL,Citation number,Citation instance,Ground truth,Dataset version\nhttps://x/?title=A_b,1,,supported,\nhttps://x/?title=A_b,2,1,not_supported,v2\n")
    inject = ["--input", table, "--output", tmp_path / "o.json", "--article", HERE + "page", "--source", HERE + "source"]
    assert call(spark, "extract", *inject, "--dry-run") == (0, "2 citations of 1 articles\n")
    assert call(spark, "extract", *inject) == (0, "complete: 1\nno_source_url: 1\n")
    rows = json.loads((tmp_path / "o.json").read_text())["rows"]
    assert [(r["id"], r["ground_truth"], r["dataset_version"]) for r in rows] == [("row_1", "Supported", "v1"), ("row_2", "Not supported", "v2")]
    assert call(spark, "extract", *inject, "--version", "v2") == (0, "no_source_url: 1\n")


def test_convert(spark, tmp_path):
    claim = {"label": "supported", "claim": "C", "evidence": ["(meta data) TITLE: T", "One."], "supporting_sentences": [[1]], "meta": {"id": "d1", "claim_title": "A b", "claim_section": "", "claim_context": ""}}
    (tmp_path / "c.jsonl").write_text(json.dumps(claim) + "\n\n")
    (tmp_path / "s.jsonl").write_text("".join(json.dumps({"label": x, "claim": "s", "meta": {"id": f"d1-{i}"}}) + "\n" for i, x in enumerate(["supported", "not_supported"])))
    code, said = call(spark, "convert", "--claims", tmp_path / "c.jsonl", "--subclaims", tmp_path / "s.jsonl", "--split", "dev", "--output", tmp_path / "o.json")
    assert code == 0 and "projection mixed: 1" in said and json.loads((tmp_path / "o.json").read_text())["rows"][0]["id"] == "wice_d1"


def test_select_and_sweep(spark, tmp_path):
    spark.createDataFrame([(1, 9, 0), (2, 9, 0), (3, 8, 0)], "tl_from long, tl_target_id long, tl_from_namespace int").write.parquet(f"{tmp_path}/l")
    spark.createDataFrame([(9, 10, "Failed_verification"), (8, 10, "X")], "lt_id long, lt_namespace int, lt_title string").write.parquet(f"{tmp_path}/t")
    spark.createDataFrame([(i, f"P_{i}", i, 0, int(i == 2)) for i in (1, 2, 3)], "page_id long, page_title string, page_latest long, page_namespace int, page_is_redirect int").write.parquet(f"{tmp_path}/p")
    code, said = call(spark, "select", "--links", f"{tmp_path}/l", "--targets", f"{tmp_path}/t", "--pages", f"{tmp_path}/p")
    assert code == 0 and said == '{"page_id":1,"title":"P 1","revision_id":1}\n'
    log = f"{tmp_path}/log"
    argv = ["sweep", "--pages", HERE + "changes", "--match", "the tool", "--log", log, "--lookback-hours", "x", "--wikis"]
    assert call(spark, *argv, "en,fr") == (0, "en: 2 new\nfr: 2 new\n")
    assert call(spark, *argv, "bad,en") == (1, "en: 0 new\n")
