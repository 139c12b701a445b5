"""op3 and the components below it, against brute force."""

import collections
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corrobora.llm.components import components
from corrobora.llm.jaccard import LocalIndex, jaccard_components, keep_one, opening
from tests.llm.helpers import ODD, docs


def shingles(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < k:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, num=90, den=100, k=3):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))
    links = [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return [(rows[i][0], len(sets[i]), least[find(i)], links[i]) for i in range(len(rows))]


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(300)] + ["the", "of"] * 40
    passage = [rng.choice(words) for _ in range(40)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            base = (rows[rng.randrange(len(rows))][1] or "").split()
            for _ in range(rng.randrange(0, 4)):
                if base:
                    base[rng.randrange(len(base))] = rng.choice(words)
            text = " ".join(base + ([rng.choice(words)] if rng.random() < 0.3 else []))
        else:
            text = " ".join([rng.choice(words) for _ in range(rng.choice([1, 2, 3, 20, 80, 200]))] + (passage if rng.random() < 0.4 else []))
        rows.append((1000 + i * 7 % 1009, text.upper() if rng.random() < 0.1 else text))
    return rows


@pytest.mark.parametrize(("seed", "short", "block"), [(1, 24, 1_500_000), (2, 3, 300)])
def test_components_and_links_match_brute_force(spark, seed, short, block):
    rows = corpus(seed) + ODD
    got = jaccard_components(docs(spark, rows), short=short, block_shingles=block).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


def test_keep_one_leaves_one_of_each_group(spark):
    rows = corpus(3, 80) + ODD
    kept = [(r.doc_id, r.text) for r in keep_one(docs(spark, rows)).collect()]
    want = brute(rows, 80, 100, 5)
    wordless = [(i, t) for (i, t), w in zip(rows, want, strict=True) if not w[1]]
    groups = {w[2] for w in want if w[1]}
    worded = [x for x in kept if shingles(x[1], 5)]
    assert sorted((x for x in kept if not shingles(x[1], 5)), key=str) == sorted(wordless, key=str)
    assert sorted((x[0] for x in worded), key=str) == sorted(groups, key=str)


def test_keep_one_keeps_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "a b c d e f", 1, "x"), (2, "a b c d e f", 2, "y")], "doc_id long, text string, cid int, rowkey string")
    assert [tuple(r) for r in keep_one(frame).collect()] == [(1, "a b c d e f", 1, "x")]


def test_empty_table(spark):
    assert jaccard_components(docs(spark, ODD).limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=25), min_size=1, max_size=12), st.integers(1, 20))
def test_divide_skip_counts_what_reaches_the_threshold(sets, least):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    index = LocalIndex(arrays)
    for query in sets:
        counts = index.occurrences(np.array(sorted(query), np.uint64), least)
        for other, n in zip(sets, counts.tolist(), strict=True):
            true = len(query & other)
            assert n == true if true >= least else n < least


def test_opening_covers_the_threshold():
    for n in range(1, 60):
        assert opening(n, 90, 100) == n - -(-90 * n // 100) + 1 >= 1


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(7, 7), (1000, 999)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 0 for i in range(40)) and got[1000] == got[999] == 999


def test_short_lists_are_merged_and_long_ones_probed():
    """A cluster of near copies, of sets that share one common part, and of odd ones: both branches are taken and nothing is missed."""
    rng = np.random.default_rng(4)
    common, base = rng.integers(0, 2**60, 40), rng.integers(0, 2**60, 120)
    sets = []
    for i in range(200):
        own = base.copy() if i < 80 else np.concatenate([common, rng.integers(0, 2**60, int(rng.integers(5, 90)))])
        own[rng.integers(0, len(own), 1 + i % 9)] = rng.integers(0, 2**60)
        sets.append(np.unique(own.astype(np.uint64)))
    index = LocalIndex(sets)
    for i, query in enumerate(sets):
        need = np.array([-(-90 * (len(query) + len(s)) // 190) for s in sets])
        hit, shared = index.reaching(query, need, -(-90 * len(query) // 100))
        true = np.array([len(np.intersect1d(query, s)) for s in sets])
        assert hit.tolist() == np.flatnonzero(true >= need).tolist() and shared.tolist() == true[hit].tolist() and i in hit
    assert index.took["heap"] > 50 and index.took["probe"] > 1000


def test_hubs_are_joined_where_their_links_are(spark, monkeypatch):
    from corrobora.llm import components as C

    monkeypatch.setattr(C, "FEW_LINKS", 5)
    rng = random.Random(8)
    edges = [(10_000 + h, rng.randrange(2000)) for h in range(6) for _ in range(300)] + [(i, i + 1) for i in range(3000, 3030)] + [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(250)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert C.heavy_links(10**9) * C.MOST_HEAVY <= 2 * 10**9 and C.heavy_links(10) == 5


def test_texts_are_sent_without_the_broadcast_too(spark, monkeypatch):
    from corrobora.llm import jaccard

    monkeypatch.setattr(jaccard, "MOST_MEMBERS", 0)
    rows = corpus(5, 60) + ODD
    got = jaccard_components(docs(spark, rows)).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)
