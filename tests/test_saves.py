"""Saves in parts, envelopes written by tasks, and the edit log by days."""

import json

import pytest
from pyspark.sql import functions as F

from corrobora import cli
from corrobora.sources import files, parts
from tests.test_commands import call

HERE = "tests.test_saves:"
ROWS = "entry_id string, provider string, v int"
CALLS: list[str] = []


def reply(prompt):
    return {"text": json.dumps({"verdict": "SUPPORTED", "confidence": 90})}


def models():
    return {"a": reply}


def test_parts_count_when_whole(spark, tmp_path):
    path = f"{tmp_path}/r.json"
    assert parts.saved(spark, path) is None
    parts.save(spark.createDataFrame([("x", "a", 1)], ROWS), path)
    broken = spark.createDataFrame([("y", "a", 2)], ROWS).withColumn("v", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        parts.save(broken, path)
    parts.save(spark.createDataFrame([("z", "a", 3)], ROWS), path)
    assert sorted(map(tuple, parts.saved(spark, path).collect())) == [("x", "a", 1), ("z", "a", 3)]
    old = spark.createDataFrame([("x", "a", 0), ("x", "b", 0)], ROWS)
    parts.finish(parts.replaced(old, parts.saved(spark, path), ["entry_id", "provider"]), path, {"k": 1})
    body = json.loads((tmp_path / "r.json").read_text())
    assert body["metadata"] == {"k": 1} and sorted(r["v"] for r in body["rows"]) == [0, 1, 3] and parts.saved(spark, path) is None


def test_envelope_keeps_order_over_many_files(spark, tmp_path):
    path = f"{tmp_path}/o.json"
    for n in (0, 1, 500):
        files.write_rows(spark.range(n).orderBy("id").withColumn("t", F.lit('a,\n"é"')), path, {"n": n})  # also over an earlier file
        body = json.loads((tmp_path / "o.json").read_text())
        assert body["metadata"] == {"n": n} and body["rows"] == [{"id": i, "t": 'a,\n"é"'} for i in range(n)]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["o.json"]


def test_a_run_that_ends_early_goes_on(spark, tmp_path, monkeypatch):
    data, path = tmp_path / "d.json", tmp_path / "r.json"
    data.write_text(json.dumps([{"id": f"row_{i}", "ground_truth": "Supported", "extraction_status": "complete", "claim_text": "c", "source_text": "The claim."} for i in range(6)]))
    argv = ["run", "--dataset", data, "--results", path, "--models", HERE + "models", "--save-every", 2]
    done = []

    def crash(rows, where):
        if len(done) == 2:
            raise RuntimeError("killed")
        done.append(1)
        parts.save(rows, where)

    monkeypatch.setattr(cli, "save", crash)
    with pytest.raises(RuntimeError, match="killed"):
        call(spark, *argv)
    assert parts.saved(spark, str(path)).count() == 4 and not path.exists()
    monkeypatch.setattr(cli, "save", parts.save)
    assert call(spark, *argv, "--resume") == (0, "a: 2/2 exact, 0 partial, 0 wrong, 0 errors\n")
    assert sorted(r["entry_id"] for r in json.loads(path.read_text())["rows"]) == [f"row_{i}" for i in range(6)] and parts.saved(spark, str(path)) is None


def _lines(path):
    return [json.loads(x) for d in sorted(path.glob("day=*")) for f in sorted(d.glob("part-*")) for x in f.read_text().splitlines()]


def test_log_is_sorted_over_its_files_and_touched_by_days(spark, tmp_path):
    def edits(*stamps):
        return spark.createDataFrame([(w, i, s) for i, s in enumerate(stamps) for w in ("fr", "en")], "wiki string, revid long, timestamp string").select(
            *(F.col(c) if c in ("wiki", "revid", "timestamp") else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in files.LOG.split(", "))))

    path = tmp_path / "log"
    path.write_text(json.dumps({"wiki": "de", "revid": 1, "timestamp": "2024-01-02T00:00:00Z"}) + "\n")  # a log in one file
    files.merge_log(edits("2024-01-03T05:00:00Z", "2024-01-01T00:00:00Z", None), str(path))
    key = lambda r: (r["timestamp"] or "", r["wiki"] or "", r["revid"] or 0)
    assert len(_lines(path)) == 7 and _lines(path) == sorted(_lines(path), key=key) and list(_lines(path)[0]) == sorted(_lines(path)[0])
    before = {f: f.stat().st_mtime_ns for f in path.glob("day=*/part-*")}
    files.merge_log(edits("2024-01-03T01:00:00Z", "2024-01-03T09:00:00Z"), str(path))
    assert len(_lines(path)) == 11 and _lines(path) == sorted(_lines(path), key=key)
    after = {f: f.stat().st_mtime_ns for f in path.glob("day=*/part-*")}
    assert {f.parent.name for f in set(before.items()) ^ set(after.items()) for f in f[:1]} == {"day=2024-01-03"}
    assert files.read_log(spark, str(path)).count() == 11 and files.read_log(spark, str(path), since="2024-01-03").count() == 8


def test_a_corpus_file_is_copied_for_executors(spark, tmp_path):
    from corrobora.sources.corpus import reachable

    (tmp_path / "c.jsonl").write_text('{"a": 1}\n')
    assert reachable(spark, f"{tmp_path}/c.jsonl") == f"{tmp_path}/c.jsonl"
    there = reachable(spark, f"{tmp_path}/c.jsonl", copied=True)
    assert not there.startswith(str(tmp_path)) and files.read_jsonl(spark, there, "a int").first()["a"] == 1
