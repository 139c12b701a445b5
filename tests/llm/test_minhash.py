"""op12 against brute force."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from corrobora.llm.arrowtext import buffers
from corrobora.llm.jaccard import class_id, shingle_sets
from corrobora.llm.minhash import K, Linker, as_stars, block_links, least_shared, near_duplicates, own_least, pair_least
from tests.llm.helpers import ODD, docs
from tests.llm.test_jaccard import brute, corpus, shingles


def expected(rows, num=85, k=5):
    return sorted(((i, n, c, i == c) for i, n, c, _ in brute(rows, num, 100, k)), key=str)


def found(spark, rows, **how):
    return sorted((tuple(r) for r in near_duplicates(docs(spark, rows), **how).collect()), key=str)


def family(seed, groups, size, words):
    """Groups of near copies of one text, with a passage that all share."""
    rng = random.Random(seed)
    passage, rows = [f"p{i}" for i in range(30)], []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(words)}" for _ in range(words)] + passage
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randrange(0, 5)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(9)}"
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = corpus(1) + [(1000 + i, t) for i, (_, t) in enumerate(ODD)] + ODD
    assert found(spark, rows) == expected(rows)


def test_long_lists_and_many_blocks(spark):
    rows = family(3, 6, 40, 200)
    assert found(spark, rows, short=4, block_shingles=2_000) == expected(rows)


def test_repeated_ids_and_extra_columns(spark):
    rows = [(1, f"a b c d e f g h {i}") for i in range(30)] + [(2, "same text of six words here")] * 30 + [(None, "same text of six words here")]
    frame = docs(spark, rows).withColumns({"cid": F.lit(7), "cluster": F.lit(7), "Sketch": F.lit(7)})
    assert sorted((tuple(r) for r in near_duplicates(frame).collect()), key=str) == expected(rows)


def test_an_empty_table(spark):
    assert found(spark, []) == []


def test_the_bound_holds_on_linked_pairs():
    rng = np.random.default_rng(4)
    worst = K
    for n in (10, 40, 56, 64, 70, 100, 400, 3000):
        for _ in range(200):
            union = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
            apart = int(n * 15 / 100)
            half = int(rng.integers(0, apart + 1))
            a, b = np.sort(union[apart - half :]), np.sort(np.concatenate([union[: apart - half], union[apart:]]))
            a, b = np.unique(a), np.unique(b)
            shared = len(np.intersect1d(a, b))
            if not len(a) or not len(b) or 100 * shared < 85 * (len(a) + len(b) - shared):
                continue
            kept = len(np.intersect1d(a[:K], b[:K]))
            assert kept >= pair_least(len(a), len(b), K, 85, 100) and kept >= own_least(np.array([len(a)]), K, 85, 100)[0]
            worst = min(worst, kept) if n > 400 else worst
    assert least_shared(K, 85, 100) == 30 < worst


def test_a_block_of_near_copies_takes_one_comparison_a_member():
    rows = family(5, 2, 300, 300)
    texts = sorted({t for _, t in rows})
    sets = list(shingle_sets(*buffers(pa.array(texts)), 5, True))
    linker = Linker(sets, np.arange(len(sets)), K, 85, 100)
    linker.neighbours()
    linker.search()
    assert linker.verified < 4 * len(sets)
    cids = [class_id(s) for s in sets]
    frame = pd.DataFrame({"cid": cids, "text": texts, "comp": cids, "side": 0, "bi": 0, "bj": 0})
    links = block_links(frame, 5, True, K, 85, 100)
    want = [shingles(t, 5) for t in texts]
    linked = {frozenset((i, j)) for i in range(len(want)) for j in range(i) if 100 * len(want[i] & want[j]) >= 85 * len(want[i] | want[j])}
    place = {c: i for i, c in enumerate(cids)}
    given = {frozenset((place[a], place[b])) for a, b in zip(links["a"], links["b"], strict=True)}
    assert given <= linked and spans(given, len(want)) == spans(linked, len(want))


def test_blocks_give_stars():
    """Chains and forests keep their components, and every link ends at its component's smallest class."""
    rng = random.Random(8)
    for n in (1, 2, 40):
        pairs = [(i + 1, i) if rng.random() < 0.5 else (i, i + 1) for i in range(n - 1) if rng.random() < 0.9]
        stars = as_stars(pd.DataFrame(pairs, columns=["a", "b"]).astype("int64"))
        given = set(zip(stars["a"].tolist(), stars["b"].tolist(), strict=True))
        assert spans(given, n) == spans(pairs, n) and all(spans(given, n)[a] == b < a for a, b in given) and len(given) == len(pairs)


def test_clusters_of_one_block_need_no_rounds(spark, monkeypatch):
    from corrobora.llm import components as C
    from corrobora.llm import minhash as M

    rounds, star, whole, rows = [], C._star, C.components, family(3, 6, 40, 200)
    monkeypatch.setattr(C, "_star", lambda edges, large, heavy: rounds.append(len(calls)) or star(edges, large, heavy))
    calls = []
    monkeypatch.setattr(M, "components", lambda links: calls.append(1) or whole(links))
    assert found(spark, rows) == expected(rows)
    assert len(calls) == 2 and 2 not in rounds


def spans(links, n):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in map(tuple, links):
        root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]
