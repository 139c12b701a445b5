"""N-gram Jaccard self-join by T-occurrence search.

Two documents link when their sets of word shingles have a Jaccard similarity
of at least num/den. The stages:

1. Every text is reduced to the 64-bit hashes of its distinct shingles. Equal
   sets are one class, so exact copies are compared once, however many.
2. Shingles are put in one fixed order, frequent ones last (``frequent``: the
   most common of the shingles that open some document's set, a broadcast of
   at most ``most_frequent`` hashes; it decides cost, never results). A class
   of n shingles opens with its p = n - ceil(t n) + 1 first ones, its short
   inverted lists: two linked classes share one of these, and at least
   T - max(n - p) of them, where T is the overlap that the threshold asks for.
   Lists of at most ``short`` classes give counted pairs; in a longer list each
   class is tied to the next size-compatible one, so such lists cost no pairs.
3. Ties and pairs that reach the count make clusters (connected components).
   A linked pair is always inside one cluster.
4. Inside a cluster a local inverted index answers a T-occurrence query for
   every class by DivideSkip: the short lists are merged through a heap, then
   the classes with at least T - L occurrences are probed by binary search in the
   L longest lists; those reaching T are links. A cluster of more than
   ``block_shingles`` shingles is dealt into blocks, and each pair of blocks is
   a group of its own, so no task grows with a cluster and no link is lost.
5. Links inside a task are returned as a spanning forest and counts; components
   over these, taken back to documents, give the smallest doc_id reachable.

Defined results: a text without words (or null) has no shingles, links with
nothing and is its own component; with fewer words than a shingle the whole
sequence is one; a null doc_id is linked like any other but never names a
component (null only where all of it are null); repeated rows are copies; an
empty table gives no rows; extra columns are kept by ``keep_one`` and not read
by ``jaccard_components``. Classes are told apart by 64-bit hashes of sets of
64-bit shingle hashes.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.llm.arrowtext import NON_SPACE, blocks, buffers, give_back, gives_back, mix64, span_hashes, spans, windows
from corrobora.llm.components import components
from corrobora.llm.durable import materialize

#: DivideSkip: weight of the longest list's logarithm in the number of lists set aside; postings that a heap
#: merges; long lists a step.
MU, HEAP, STEP = 0.01, 2048, 16
#: Keys of clusters' members that may be broadcast, 8 bytes each, to choose the texts that are sent to clusters.
MOST_MEMBERS = 4_000_000
#: Rows of a group after which its worker gives memory back.
LARGE = 500


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, lower: bool) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    starts, ends, first = spans(data, offsets, NON_SPACE)
    words = span_hashes(data, starts, ends, lower=lower)
    shingles = windows(words, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(shingles[a : b - k + 1])
        elif b > a:
            yield mix64(windows(words[a:b], b - a) ^ np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def class_id(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def opening(n: int, num: int, den: int) -> int:
    """How many shingles of a set of n one linked set must share one of."""
    return n - -(-num * n // den) + 1


def counted(n: int, num: int, den: int) -> int:
    """How many shingles of a set of n, in hash order, are counted: those that can come to open it when a third of them are put last."""
    p = opening(n, num, den)
    return min(n, p + p // 2 + 8)


def _sets(batches: Iterator[pa.RecordBatch], k: int, lower: bool):
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for i, j in blocks(offsets):
            yield batch.slice(i, j - i), list(shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k, lower))


@gives_back
def _open_counts(batches: Iterator[pa.RecordBatch], k: int, lower: bool, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """How many sets of a block open, in hash order, with each shingle; copies in a block count once."""
    for _, sets in _sets(batches, k, lower):
        own = {s.tobytes(): s for s in sets if len(s)}.values()
        if own:
            hashes, counts = np.unique(np.concatenate([s[: counted(len(s), num, den)] for s in own]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], ["g", "n"])


@gives_back
def _openings(batches: Iterator[pa.RecordBatch], k: int, lower: bool, num: int, den: int, frequent) -> Iterator[pa.RecordBatch]:
    """doc_id, class, n and the opening shingles, in the order that puts frequent ones last."""
    common = frequent.value
    for rows, sets in _sets(batches, k, lower):
        sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
        late = np.zeros(len(flat), dtype=bool)
        if len(common):
            at = np.searchsorted(common, flat)
            at[at == len(common)] = 0
            late = common[at] == flat
        ends = np.cumsum(sizes)
        opens = []
        for s, a, b in zip(sets, (ends - sizes).tolist(), ends.tolist(), strict=True):
            p = opening(b - a, num, den) if b > a else 0
            mine = late[a:b]
            if mine[:p].any():
                s = np.concatenate([s[~mine], s[mine]])
            opens.append(s[:p])
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum([len(x) for x in opens])]).astype(np.int32)), pa.array(np.concatenate([*opens, np.zeros(0, np.uint64)]).view(np.int64)),
        )
        ids = pa.array([class_id(s) if len(s) else None for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("key"), ids, pa.array(sizes), lists], ["doc_id", "key", "cid", "n", "opening"])


@gives_back
def _candidates(batches: Iterator[pa.RecordBatch], num: int, den: int, short: int) -> Iterator[pa.RecordBatch]:
    """From postings sorted by (g, n, cid): pairs of short lists, ties of long ones. Holds ``short`` postings at most."""
    buffer_g = np.zeros(0, np.int64)
    buffer_c, buffer_n = buffer_g, buffer_g
    hub = None  # of a list longer than `short`: (g, hub, its n, last cid, last n)

    def rows(a, b, na, nb, tie):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, na, nb, tie)], ["a", "b", "na", "nb", "tie"])

    def ties(g: int, cids: np.ndarray, sizes: np.ndarray) -> tuple[list, list, list, list]:
        """Each class to the first one of its size band, each band's first to the class before it."""
        nonlocal hub
        out: list[tuple[int, int, int, int]] = []
        for c, n in zip(cids.tolist(), sizes.tolist(), strict=True):
            if hub is None or hub[0] != g:
                hub = (g, c, n, c, n)
                continue
            _, first, size, last, last_n = hub
            if den * size >= num * n:
                out.append((first, c, size, n))
                hub = (g, first, size, c, n)
            else:
                if den * last_n >= num * n:
                    out.append((last, c, last_n, n))
                hub = (g, c, n, c, n)
        return tuple(zip(*out, strict=True)) if out else ((), (), (), ())

    def run(g: np.ndarray, c: np.ndarray, n: np.ndarray):
        edges = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        sizes = np.diff(np.append(edges, len(g)))
        for length in np.unique(sizes[(sizes > 1) & (sizes <= short)]).tolist():
            at = edges[sizes == length]
            left, right = np.triu_indices(length, 1)
            i, j = (at[:, None] + left).ravel(), (at[:, None] + right).ravel()
            ok = den * n[i] >= num * n[j]
            i, j = i[ok], j[ok]
            swap = c[i] > c[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            yield rows(c[i], c[j], n[i], n[j], np.zeros(len(i), np.int64))
        for at, length in zip(edges[sizes > short].tolist(), sizes[sizes > short].tolist(), strict=True):
            a, b, na, nb = ties(int(g[at]), c[at : at + length], n[at : at + length])
            if a:
                yield rows(a, b, na, nb, np.ones(len(a), np.int64))

    for batch in batches:
        g, c, n = (batch.column(x).to_numpy() for x in ("g", "cid", "n"))
        if not len(g):
            continue
        if hub is not None and g[0] == hub[0]:  # a long list goes on
            end = int(np.searchsorted(g, hub[0], "right"))
            a, b, na, nb = ties(hub[0], c[:end], n[:end])
            if a:
                yield rows(a, b, na, nb, np.ones(len(a), np.int64))
            g, c, n = g[end:], c[end:], n[end:]
            if not len(g):
                continue
        g, c, n = np.concatenate([buffer_g, g]), np.concatenate([buffer_c, c]), np.concatenate([buffer_n, n])
        last = int(np.searchsorted(g, g[-1], "left"))
        yield from run(g[:last], c[:last], n[:last])
        if len(g) - last > short:
            yield from run(g[last:], c[last:], n[last:])
            last = len(g)
        buffer_g, buffer_c, buffer_n = g[last:], c[last:], n[last:]
    if len(buffer_g):
        yield from run(buffer_g, buffer_c, buffer_n)


class LocalIndex:
    """Inverted lists of a group of sets; a list holds set numbers in ascending order."""

    def __init__(self, sets: list[np.ndarray]):
        self.count, self.sizes = len(sets), np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        hashes = flat[order]
        del flat
        self.first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        self.key, self.end = hashes[self.first], np.append(self.first[1:], len(hashes))
        del hashes
        # all postings in one ascending array: the list's number times the number of sets, and the set's number
        self.code = np.repeat(np.arange(self.count), self.sizes)[order]
        del order
        self.code += np.repeat(np.arange(len(self.first)) * self.count, self.end - self.first)
        self.took = Counter()

    def occurrences(self, query: np.ndarray, least: int) -> np.ndarray:
        """Overlap with the query of each set that reaches ``least``, 0 for the others."""
        found, shared = self.reaching(query, np.full(self.count, least), least)
        out = np.zeros(self.count, np.int64)
        out[found] = shared
        return out

    def reaching(self, query: np.ndarray, need: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The sets, and their overlaps, that share at least ``need`` (one number for each set, ``least`` or more) entries with the query: DivideSkip.

        The L longest lists are set aside, L by the longest one's length; the
        others are merged through a heap and counted (more than ``HEAP`` postings
        are counted without being put in order, which gives the same). Sets that
        then miss their number by more than L are out. The others are probed in
        the long lists by binary search, some lists at a time, shorter ones
        first; sets that can't reach their number any more are dropped after
        each step.
        """
        at = np.searchsorted(self.key, query)
        at = at[self.key[np.minimum(at, len(self.key) - 1)] == query]
        size = self.end[at] - self.first[at]
        aside = min(max(0, least - 1), int(least / (MU * np.log2(max(2, size.max(initial=1))) + 1)))
        order = at[np.argsort(size, kind="stable")]
        cut = max(0, len(order) - aside)
        counts = self._merge(order[:cut])
        left = len(order) - cut
        open_ = np.flatnonzero((counts >= need - left) & (counts > 0) & (need <= np.minimum(self.sizes, len(query))))
        for i in range(cut, len(order), STEP):
            if not len(open_):
                break
            part = order[i : i + STEP]
            want = (part[:, None] * self.count + open_[None, :]).ravel()
            found = np.searchsorted(self.code, want)
            found[found == len(self.code)] = 0
            counts[open_] += (self.code[found] == want).reshape(len(part), -1).sum(axis=0)
            self.took["probe"] += len(want)
            left -= len(part)
            open_ = open_[counts[open_] + left >= need[open_]]
        open_ = open_[counts[open_] >= need[open_]]
        return open_, counts[open_]

    def _merge(self, lists: np.ndarray) -> np.ndarray:
        """How often each set occurs in the lists."""
        if int((self.end[lists] - self.first[lists]).sum()) > HEAP:
            self.took["count"] += 1
            return np.bincount(self._members(lists), minlength=self.count)
        self.took["heap"] += 1
        counts = np.zeros(self.count, np.int64)
        for x in heapq.merge(*((self.code[a:b] - x * self.count).tolist() for x, a, b in zip(lists.tolist(), self.first[lists].tolist(), self.end[lists].tolist(), strict=True))):
            counts[x] += 1
        return counts

    def _members(self, lists: np.ndarray) -> np.ndarray:
        first, size = self.first[lists], self.end[lists] - self.first[lists]
        total = np.cumsum(size) - size
        return self.code[np.repeat(first - total, size) + np.arange(int(size.sum()))] - np.repeat(lists * self.count, size)


def linked_groups(frame: pd.DataFrame, k: int, lower: bool, num: int, den: int) -> pd.DataFrame:
    """Links inside a group of texts (or between its two blocks): each class's root in the group and its number of linked rows.

    A row whose text is of another class (a doc_id used twice) is none of the group.
    """
    frame = frame.drop_duplicates(["cid", "text"]).sort_values("cid")
    sets = list(shingle_sets(*buffers(pa.array(frame["text"], pa.string())), k, lower))
    own = np.array([len(s) > 0 and class_id(s) == c for s, c in zip(sets, frame["cid"], strict=True)], dtype=bool)
    frame, sets = frame[own], [s for s, x in zip(sets, own.tolist(), strict=True) if x]
    if frame["cid"].duplicated().any():  # texts that differ, with one set
        first = ~frame["cid"].duplicated().to_numpy()
        frame, sets = frame[first], [s for s, x in zip(sets, first.tolist(), strict=True) if x]
    if not sets:
        return pd.DataFrame({"cid": [], "root": [], "links": []}).astype("int64")
    cids, sizes, copies = frame["cid"].to_numpy(), frame["n"].to_numpy(), frame["copies"].to_numpy()
    side = frame["block"].to_numpy()
    across = frame["bi"].iloc[0] != frame["bj"].iloc[0]
    low = side == frame["bi"].iloc[0]
    index, links, root = LocalIndex(sets), np.zeros(len(sets), np.int64), np.arange(len(sets))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, query in enumerate(sets):
        if across and not low[i]:
            continue
        n = len(query)
        need = -(-num * (n + sizes) // (num + den))
        least = -(-num * n // den)  # the least overlap with a set of any size
        hit, _ = index.reaching(query, need, least)
        hit = hit[~low[hit]] if across else hit[hit != i]
        links[i] += copies[hit].sum()
        if across:
            links[hit] += copies[i]
        for j in hit.tolist():
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
    roots = np.array([find(i) for i in range(len(sets))], np.int64)
    return pd.DataFrame({"cid": cids, "root": cids[roots], "links": links})


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key to find a row's text by: the doc_id, or a hash of the text where it is null."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.xxhash64("text")).alias("key"), "text")


def class_table(docs: DataFrame, k: int, lower: bool, num: int, den: int, short: int, most_frequent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, cid, n) and classes (cid, n, rep, key, copies, opening), both written."""
    spark = docs.sparkSession
    text = _keyed(docs)
    counted = text.select("text").mapInArrow(partial(_open_counts, k=k, lower=lower, num=num, den=den), "g long, n long")
    common = counted.groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") > short).orderBy(F.desc("n"), "g").limit(most_frequent).select("g").toPandas()["g"]
    frequent = spark.sparkContext.broadcast(np.sort(common.to_numpy(np.int64).view(np.uint64)))
    opened = materialize(text.mapInArrow(partial(_openings, k=k, lower=lower, num=num, den=den, frequent=frequent), "doc_id long, key long, cid long, n long, opening array<long>"), "openings")
    classes = opened.where("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.coalesce(F.min("doc_id"), F.min("key")).alias("key"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("opening").alias("opening"))
    return opened.select("doc_id", "cid", "n"), materialize(classes, "classes")


def linked_classes(docs: DataFrame, k: int = 3, lower: bool = True, num: int = 90, den: int = 100, short: int = 24, most_frequent: int = 500_000, block_shingles: int = 1_500_000) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, cid, n), and classes (cid, rep, copies, links, root): root is the smallest class linked, directly or not."""
    rows, classes = class_table(docs, k, lower, num, den, short, most_frequent)
    postings = classes.select(F.explode("opening").alias("g"), "cid", "n").repartition("g").sortWithinPartitions("g", "n", "cid")
    found = postings.mapInArrow(partial(_candidates, num=num, den=den, short=short), "a long, b long, na long, nb long, tie long")
    pairs = found.groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("tie").alias("tie"), F.first("na").alias("na"), F.first("nb").alias("nb"))

    def beyond(n):  # shingles after the opening
        return F.expr(f"(({num}L * {n} + {den - 1}) div {den}) - 1")

    need = F.expr(f"({num}L * (na + nb) + {num + den - 1}) div {num + den}")
    likely = pairs.where((F.col("tie") == 1) | (F.col("shared") + F.greatest(beyond("na"), beyond("nb")) >= need)).select("a", "b")
    clusters = components(likely)
    sizes = classes.select("cid", "key", "copies", "n").join(clusters.select(F.col("node").alias("cid"), F.col("root").alias("cluster")), "cid")
    weight = sizes.groupBy("cluster").agg(F.expr(f"(sum(n) + {block_shingles - 1}) div {block_shingles}").cast("int").alias("parts"))
    members = materialize(sizes.join(weight, "cluster").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")), "members")
    texts = _keyed(docs).select("key", "text")
    if members.count() <= MOST_MEMBERS:  # other texts need not be shuffled
        texts = texts.join(F.broadcast(members.select("key").distinct()), "key", "left_semi")
    sets = texts.join(members.hint("merge"), "key").select("text", "cid", "copies", "n", "cluster", "parts", "block")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = sets.select("*", other.alias("other")).withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")})
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = linked_groups(frame, k, lower, num, den)
        if len(frame) > LARGE:
            give_back()
        return out

    linked = dealt.groupBy("cluster", "bi", "bj").applyInPandas(run, "cid long, root long, links long")
    linked = materialize(linked, "linked")
    roots = components(linked.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    counts = linked.groupBy("cid").agg(F.sum("links").alias("links"))
    named = classes.select("cid", "rep", "copies").join(counts, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    return rows, named.select("cid", "rep", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "cid").alias("root"))


def jaccard_components(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and n_links (documents it links with directly)."""
    rows, classes = linked_classes(docs, **how)
    least = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = classes.join(least, "root").select("cid", "component_id", "links")
    return rows.join(named, "cid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links"),
    )


@gives_back
def _add_class(batches: Iterator[pa.RecordBatch], k: int, lower: bool) -> Iterator[pa.RecordBatch]:
    for rows, sets in _sets(batches, k, lower):
        ids = pa.array([class_id(s) if len(s) else None for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([*rows.columns, ids], [*rows.schema.names, "cid"])


def keep_one(docs: DataFrame, k: int = 5, lower: bool = True, num: int = 80, den: int = 100, **how) -> DataFrame:
    """The documents, with all their columns, less those linked (directly or not) to one of a smaller doc_id.

    Of rows that share the smallest doc_id and the text one stays; rows without
    words all stay.
    """
    names = docs.columns
    own = [n if n in ("doc_id", "text") else f"c{i}" for i, n in enumerate(names)]
    docs = docs.toDF(*own)
    _, classes = linked_classes(docs, k=k, lower=lower, num=num, den=den, **how)
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), F.col("rep").alias("rep"), F.col("cid").alias("cid")))
    keepers = classes.groupBy("root").agg(first.alias("k")).select(F.col("k.cid").alias("keeper"), F.col("k.rep").alias("rep"), F.xxhash64("k.rep", "k.cid").alias("rowkey"))
    worded = F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    classed = docs.where(worded).mapInArrow(partial(_add_class, k=k, lower=lower), docs._jdf.schema().toDDL() + ", cid long").withColumn("rowkey", F.xxhash64(F.col("doc_id").cast("long"), "cid"))
    kept = classed.join(keepers, "rowkey").where((F.col("cid") == F.col("keeper")) & F.col("doc_id").eqNullSafe(F.col("rep"))).dropDuplicates(["rowkey"])
    return kept.select(*own).union(docs.where(~F.coalesce(worded, F.lit(False)))).toDF(*names)
