"""op11 against a sequential version."""

import hashlib
import random
import zlib

import pytest

from corrobora.llm.merkle import merkle_report
from tests.llm.helpers import DOCS


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def tree(nodes):
    """Root and each node's siblings with its slots."""
    paths, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for i, a in enumerate(at):
            run = level[a - a % 3 : a - a % 3 + 3]
            paths[i].append((run, a % 3))
        level = [sha(*level[i : i + 3]) for i in range(0, len(level), 3)]
        at = [a // 3 for a in at]
    return level[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
    trees = [tree([leaf_of(r, r[1]) for r in groups[s]]) for s in names]
    out = []
    if not rows:
        return out
    root, upper = tree([t[0] for t in trees])
    for s, (subroot, paths), up in zip(names, trees, upper, strict=True):
        for r, path in zip(groups[s], paths, strict=True):
            tampered = r[1]
            if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                tampered = r[1].replace("\n", "")
            hash_, beside = leaf_of(r, tampered), []
            for run, slot in path + up:
                beside += run[:slot] + run[slot + 1 :]
                hash_ = sha(*run[:slot], hash_, *run[slot + 1 :])
            out.append((r[0], leaf_of(r, r[1]), subroot, root, sha(*beside), hash_, hash_ == root))
    return out


def rows(seed, n, sources):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = "".join(rng.choice("ab \n\té") for _ in range(rng.randrange(20)))
        out.append((rng.choice([i, i, i, i % 7, None]), rng.choice([text, text, text, None, ""]), rng.choice(["en", None]), rng.choice(sources), rng.choice([3, None])))
    return out + out[: n // 5] + [out[0]] * (n // 3) if out else out


@pytest.mark.parametrize(("seed", "n", "sources"), [(1, 1, ["a"]), (2, 40, ["b", "a", "é", None, "", "=", "z"]), (3, 500, ["hot", "hot", "hot", "x", None]), (4, 60, [f"s{i}" for i in range(90)]), (5, 3, ["a"]), (6, 4, ["a"]), (7, 0, ["a"])])
def test_against_a_sequential_version(spark, seed, n, sources):
    given = rows(seed, n, sources)
    frame = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = [tuple(r) for r in merkle_report(frame).collect()]
    assert sorted(got, key=str) == sorted(brute(given), key=str)


def test_extra_columns_and_a_very_long_text(spark):
    given = [(1, "x\n" * 300_000, "en", "s", 1), (2, "y", "en", "s", 1)]
    frame = spark.createDataFrame([(*r, "tree", 5, "p") for r in given], f"{DOCS}, tree string, part int, path string")
    assert sorted(tuple(r) for r in merkle_report(frame).collect()) == sorted(brute(given))
    assert merkle_report(frame).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_a_tree_of_three_floors(spark):
    given = [(i, f"t\n{i}", "en", "s" if i % 3 else "r", i) for i in range(20_000)]
    frame = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long").repartition(8)
    assert sorted(tuple(r) for r in merkle_report(frame).collect()) == sorted(brute(given))
