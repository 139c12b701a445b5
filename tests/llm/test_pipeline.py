"""The corpus pipeline against brute force, stage by stage, and the registered queries on the smallest tables."""

import random

import pytest

import __spark_entry__
import corpus_pipeline
from corrobora.llm.pii import replace_in
from tests.llm.helpers import ODD, docs
from tests.llm.test_jaccard import brute, shingles
from tests.llm.test_text_rules import brute_hits, brute_quality
from tests.llm.test_tokens import brute_pieces


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(25))) for i in range(5)]
    rows = list(ODD)
    for i in range(90):
        words = [rng.choice(vocab) for _ in range(rng.randrange(30, 200))]
        if rng.random() < 0.4 and len(rows) > 20:
            words = (rng.choice(rows[len(ODD) :])[1]).split(" ")
            words[rng.randrange(len(words))] = "changed"
        if rng.random() < 0.2:
            words += items[rng.randrange(5)][1].split(" ")
        if rng.random() < 0.3:
            words.insert(5, f"mail{i}@host.example")
        if rng.random() < 0.1:
            words = words[:12] * 8
        rows.append((100 + i, " ".join(words)))
    path = str(tmp_path_factory.mktemp("sf"))
    docs(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_pipeline_matches_brute_force(spark, tables):
    path, rows, items = tables
    good = [r for r in rows if brute_quality(r[1])[-1]]
    groups = brute(good, 80, 100, 5)
    single = [r for r, g in zip(good, groups, strict=True) if g[2] == r[0] or not shingles(r[1], 5)]
    clean = [r for r, h in zip(single, brute_hits(single, items), strict=True) if not h[5]]
    private = [(i, replace_in(t)[0]) for i, t in clean]
    assert len(rows) > len(good) > len(single) > len(clean) > 0 and private != clean
    at = spark.read.parquet(f"{path}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], (good, single, clean, private), strict=True):
        at = stage(spark, at, path)
        assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert sorted(((r.doc_id, r.text) for r in at.collect()), key=str) == sorted(want, key=str), name
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(brute_pieces(private), key=str)


def test_stages_of_nothing(spark, tables):
    path = tables[0]
    at = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, path)
    assert at.count() == 0


def test_all_ten_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_stages_keep_clashing_columns(spark, tables):
    path = tables[0]
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "a", 1, 2.0, "x", "y"), (2, text + " more", "b", 2, 3.0, "x", None), (None, None, None, None, None, None, None), (3, text.replace("1", "9") + " bob@mail.example", "c", 3, 4.0, "z", "w")]
    schema = "doc_id long, text string, cid string, key long, c0 double, block string, n_words string"
    at = spark.createDataFrame(rows, schema)
    kept = [{1, 2, 3}, {1, 3}, {1, 3}, {1, 3}]
    for (name, stage), ids in zip(corpus_pipeline.STAGES[:-1], kept, strict=True):
        at = stage(spark, at, path)
        got = {r["doc_id"]: tuple(r) for r in at.collect()}
        assert at.columns == ["doc_id", "text", "cid", "key", "c0", "block", "n_words"] and set(got) - {None} == ids, name
        assert all(got[i][2:] == r[2:] for i in ids for r in rows if r[0] == i), name
    assert "bob@mail" not in got[3][1] and corpus_pipeline.packing(spark, at, path).count() == 2
