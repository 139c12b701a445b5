"""op13 against brute force."""

import hashlib
import random
import zlib

import pytest

from corrobora.llm import trie as module
from corrobora.llm.trie import conversation_trie, rebuilt_trie

TURNS = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + ts[h:]
    return own, out


def brute(convs):
    members = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children, rows = {p: [] for p in members}, []
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = sum(saved[q] for q in children[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(p))
        rows.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def corpus(seed, n, most=12):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        copy = [r for r in rows if r[0] == rng.randrange(max(1, c))] if rng.random() < 0.6 else []
        turns = [r[2:] for r in copy[: rng.randrange(len(copy) + 1)]]
        turns += [(rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "b", "é", "", None, "long " * 9])) for _ in range(rng.randrange(1, most))]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    return rows


def check(spark, given, function, convs):
    frame = spark.createDataFrame(given, TURNS).repartition(4)
    assert sorted(tuple(r) for r in function(frame).fillna(-99).collect()) == sorted(tuple(-99 if v is None else v for v in r) for r in brute(convs))


@pytest.mark.parametrize(("seed", "n"), [(1, 60), (2, 7), (3, 1), (4, 0)])
def test_rebuilt_against_brute_force(spark, seed, n):
    given = corpus(seed, n)
    check(spark, given, rebuilt_trie, rebuilt(given)[1])


def test_plain_and_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(module, "CHUNK", 3)
    given = corpus(5, 50)
    check(spark, given, conversation_trie, rebuilt(given)[0])


def test_nulls_ties_repeats_and_missing_bases(spark):
    given = [(7, None, "user", "x"), (7, 1, None, None), (7, 1, None, None), (8, 0, "u", "x"), (12, 0, "u", "only"), (14, 0, "u", "only"), (12, 3, "u", "z"), (14, 3, "u", "z")]
    check(spark, given, rebuilt_trie, rebuilt(given)[1])
    got = conversation_trie(spark.createDataFrame([*given, (None, 1, "user", "x")], TURNS).withColumns({"c": module.F.lit(1), "depth": module.F.lit(2), "KEY": module.F.lit(3)}))
    assert sorted(tuple(r) for r in got.fillna(-99).collect()) == sorted(tuple(-99 if v is None else v for v in r) for r in brute(rebuilt(given)[0]))


def test_long_shared_prefixes_and_many_copies(spark):
    same = [("user" if i % 2 else "assistant", f"t{i}") for i in range(300)]
    given = [(c, i, *t) for c in (1, 2, 3) for i, t in enumerate(same if c < 3 else [*same[:280], ("user", "other")])]
    given += [(c, 0, "user", "hello") for c in range(10, 600)]
    check(spark, given, conversation_trie, rebuilt(given)[0])
