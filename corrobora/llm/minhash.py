"""Near duplicates from bottom-k sketches of one hash function.

A document's sketch is the k smallest of its shingles' hashes. The stages:

1. Every text is reduced to its set; equal sets are one class (exact copies
   cost nothing more), and a class keeps its sketch.
2. Retained values have inverted lists. In the order of lists, frequent values
   come last and are left out of a class's lists as far as the bound allows: a
   linked pair shares ``least_shared`` retained values at least (below), so a class
   may leave out one less, and a pair that shares s values of those listed is a
   candidate where s and the values left out can reach that number.
   Lists of at most ``short`` classes give counted pairs. A longer one costs no
   pairs: its classes are put in size bands (linked sets lie in the same band or
   the next) and each is tied to its band's hub, found by partial aggregation.
3. Candidates and ties make clusters. In blocks of a cluster a local index of
   sketches counts overlaps, the estimate over the union's sketch filters, and
   full sets decide. Only components are asked for, so pairs already in one
   component are skipped: the largest component's members are never compared
   with one another, and a block of near copies takes one comparison a member.
4. Clusters of several blocks are first joined by representatives of their
   blocks' components; then members outside the cluster's largest component
   meet all blocks. A large group of near copies thus costs time linear in it.

``least_shared``: sets of k shingles or fewer are retained whole, and the number
is exact. Of others, each value of the union's sketch is in both sets with a
chance of at least num/den, and the number is the one that a binomial count
misses with a chance of ``MISS`` (10^-12) a linked pair. No link is reported that
the full sets do not confirm.

Defined results: a text without words (or null) has no shingles, links with
nothing and is its own component; with fewer words than a shingle the whole
sequence is one; a null doc_id is linked like any other but never names a
component (null only where all of it are null); ``kept`` is true where doc_id is
the component's, so for all rows of a repeated doc_id alike; repeated rows are
copies; an empty table gives no rows; extra columns are not read. Classes are
told apart by 64-bit hashes of sets of 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.llm.arrowtext import buffers, give_back, gives_back
from corrobora.llm.components import components
from corrobora.llm.durable import materialize
from corrobora.llm.jaccard import LARGE, LocalIndex, _sets, class_id, shingle_sets
from corrobora.llm.ranks import hot_join

#: Values retained; the chance that a linked pair shares fewer values than asked for.
K, MISS = 64, 1e-12
#: Frequent values that are put last, 8 bytes each; keys of clusters' members that may be broadcast. Both decide cost alone.
MOST_FREQUENT, MOST_MEMBERS = 500_000, 4_000_000


def least_shared(k: int, num: int, den: int, miss: float = MISS) -> int:
    """How many of k values, each in both sets with a chance of num/den or more, are in both; fewer with a chance of ``miss`` at most."""
    total = 0.0
    for x in range(k + 1):
        total += comb(k, x) * (num / den) ** x * (1 - num / den) ** (k - x)
        if total > miss:
            return max(1, x)
    return max(1, k)


def own_least(n: np.ndarray, k: int, num: int, den: int) -> np.ndarray:
    """How many retained values a set of n shares at least with any linked one."""
    exact = -(-num * n // den)
    return np.where(den * n // num <= k, exact, np.minimum(exact, least_shared(k, num, den)))


def pair_least(na: np.ndarray, nb: np.ndarray, k: int, num: int, den: int) -> np.ndarray:
    """How many retained values two linked sets of na and nb share at least."""
    return np.where(np.maximum(na, nb) <= k, -(-num * (na + nb) // (num + den)), least_shared(k, num, den))


@gives_back
def _sketches(batches: Iterator[pa.RecordBatch], words: int, lower: bool, k: int) -> Iterator[pa.RecordBatch]:
    for rows, sets in _sets(batches, words, lower):
        kept = [s[:k] for s in sets]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in kept])]).astype(np.int32)), pa.array(np.concatenate([*kept, np.zeros(0, np.uint64)]).view(np.int64)))
        ids = pa.array([class_id(s) if len(s) else None for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("rowkey"), ids, pa.array([len(s) for s in sets], pa.int64()), lists], ["doc_id", "rowkey", "cid", "n", "sketch"])


def _postings(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int, frequent) -> Iterator[pa.RecordBatch]:
    """(g, cid, n, rest, long): a class's listed values, how many are left out, and whether the list is known to be long."""
    common = frequent.value
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("sketch")
        offsets, values = lists.offsets.to_numpy().astype(np.int64), lists.flatten().to_numpy()
        offsets, n = offsets - offsets[0], batch.column("n").to_numpy()
        late = np.isin(values, common)
        row = np.repeat(np.arange(len(n)), np.diff(offsets))
        size, rare = np.diff(offsets), np.bincount(row[~late], minlength=len(n))
        listed = np.maximum(size - own_least(n, k, num, den) + 1, rare)
        order = np.lexsort((values, late, row))
        rank = np.arange(len(values)) - offsets[row]
        at = order[rank < listed[row]]
        yield pa.RecordBatch.from_arrays([pa.array(values[at]), pa.array(batch.column("cid").to_numpy()[row[at]]), pa.array(n[row[at]]), pa.array((size - listed)[row[at]]), pa.array(late[at])], ["g", "cid", "n", "rest", "long"])


def _row(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "na", "nb", "rest", "tie"])


@gives_back
def _overlaps(batches: Iterator[pa.RecordBatch], num: int, den: int, short: int) -> Iterator[pa.RecordBatch]:
    """From postings sorted by (g, n, cid): pairs of lists of at most ``short``; of longer ones a tie of each class to its run's first, a run having no gap in size that no link can bridge."""
    held = np.zeros((4, 0), np.int64)  # the last list, as far as it is short
    hub = None  # of a long list that goes on: g, the run's first class and its size, the last size

    def ties(part: np.ndarray):
        nonlocal hub
        g, c, n, _ = part
        before = np.concatenate([[hub[3] if hub and hub[0] == g[0] else 0], n[:-1]])
        start = np.flatnonzero(den * before < num * n)
        run = np.searchsorted(start, np.arange(len(g)), "right") - 1
        first_c, first_n = np.concatenate([c[start], [hub[1] if hub else 0]])[run], np.concatenate([n[start], [hub[2] if hub else 0]])[run]
        hub = (int(g[-1]), int(first_c[-1]), int(first_n[-1]), int(n[-1]))
        own = first_c != c
        return _row(np.minimum(first_c, c)[own], np.maximum(first_c, c)[own], first_n[own], n[own], np.zeros(own.sum()), np.ones(own.sum()))

    def run(part: np.ndarray):
        g, c, n, rest = part
        edges = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        sizes = np.diff(np.append(edges, len(g)))
        for length in np.unique(sizes[(sizes > 1) & (sizes <= short)]).tolist():
            at = edges[sizes == length]
            left, right = np.triu_indices(length, 1)
            i, j = (at[:, None] + left).ravel(), (at[:, None] + right).ravel()
            near = den * n[i] >= num * n[j]
            i, j = i[near], j[near]
            i, j = np.where(c[i] < c[j], i, j), np.where(c[i] < c[j], j, i)
            yield _row(c[i], c[j], n[i], n[j], np.maximum(rest[i], rest[j]), np.zeros(len(i)))
        for at, length in zip(edges[sizes > short].tolist(), sizes[sizes > short].tolist(), strict=True):
            yield ties(part[:, at : at + length])

    for batch in batches:
        part = np.concatenate([held, np.stack([batch.column(x).to_numpy() for x in ("g", "cid", "n", "rest")])], axis=1)
        held = part[:, :0]
        if hub is not None and part.shape[1] and part[0, 0] == hub[0]:  # a long list goes on
            end = int(np.searchsorted(part[0], hub[0], "right"))
            yield ties(part[:, :end])
            part = part[:, end:]
        if part.shape[1]:
            last = int(np.searchsorted(part[0], part[0, -1], "left"))
            last = part.shape[1] if part.shape[1] - last > short else last
            yield from run(part[:, :last])
            held = part[:, last:]
    yield from run(held) if held.shape[1] else ()


def _band(n: Column, num: int, den: int) -> Column:
    """Sets that can link lie in one band or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / float(np.log(den / num)) + 1e-9).cast("long")


def _long_lists(postings: DataFrame, num: int, den: int) -> DataFrame:
    """Ties (a, b) of the long lists' classes to their bands' hubs, and of hubs of neighbouring bands."""
    banded = postings.where("long").select("g", "cid", _band(F.col("n"), num, den).alias("band"))
    hubs = materialize(banded.groupBy("g", "band").agg(F.min("cid").alias("hub"), F.count("*").alias("size")), "hubs")
    spokes = hot_join(banded, hubs, ["g", "band"], "size").select(F.col("cid").alias("a"), F.col("hub").alias("b"))
    following = hubs.select("g", (F.col("band") - 1).alias("band"), F.col("hub").alias("b"))
    return spokes.union(hubs.select("g", "band", F.col("hub").alias("a")).join(following, ["g", "band"]).select("a", "b")).where("a <> b").distinct()


class Linker:
    """Links of a block's sets, as a spanning forest over the components they start in."""

    def __init__(self, sets: list[np.ndarray], comps: np.ndarray, k: int, num: int, den: int):
        self.sets, self.k, self.num, self.den = sets, k, num, den
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.label = np.unique(comps, return_inverse=True)[1].astype(np.int64)
        self.found: list[tuple[int, int]] = []
        self.verified, self.bound = 0, least_shared(k, num, den)

    def estimated(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that may link with i by the sketch of the union: its k smallest values, so far as both have them."""
        mine = self.sets[i][: self.k]
        sketches = [self.sets[j][: self.k] for j in others.tolist()]
        width = np.array([len(x) for x in sketches])
        flat = np.concatenate(sketches)
        own = np.arange(len(flat)) - np.repeat(np.cumsum(width) - width, width)  # rank in the other's sketch
        at = np.searchsorted(mine, flat)
        both = mine[np.minimum(at, len(mine) - 1)] == flat
        total = np.cumsum(both) - both
        before = total - np.repeat(total[np.cumsum(width) - width], width)  # values of both that are smaller
        inside = both & (at + own - before < self.k)
        counts = np.add.reduceat(inside, np.cumsum(width) - width, dtype=np.int64)
        return others[(counts >= self.bound) | (np.maximum(self.sizes[others], len(self.sets[i])) <= self.k)]

    def confirmed(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that link with i by the whole sets."""
        if not len(others):
            return others
        self.verified += len(others)
        mine, width = self.sets[i], self.sizes[others]
        flat = np.concatenate([self.sets[j] for j in others.tolist()])
        at = np.searchsorted(mine, flat)
        shared = np.add.reduceat(mine[np.minimum(at, len(mine) - 1)] == flat, np.cumsum(width) - width, dtype=np.int64)
        return others[self.den * shared >= self.num * (len(mine) + width - shared)]

    def link(self, i: int, others: np.ndarray) -> bool:
        """Joins i with those of ``others`` that link with it, one for each component."""
        others = others[self.label[others] != self.label[i]]
        hits = self.confirmed(i, self.estimated(i, others)) if len(others) else others
        for j in hits[np.unique(self.label[hits], return_index=True)[1]].tolist():
            self.label[self.label == self.label[j]] = self.label[i]
            self.found.append((i, j))
        return len(hits) > 0

    def neighbours(self) -> None:
        """Sets whose sketches are next to each other in order: near copies mostly are."""
        order = sorted(range(len(self.sets)), key=lambda i: self.sets[i][: self.k].tobytes())
        for i, j in zip(order[:-1], order[1:], strict=True):
            self.link(i, np.array([j]))

    def search(self, low: np.ndarray | None = None) -> None:
        """All pairs of different components, each from a set outside the largest; with ``low``, only pairs across it.

        Sets that share most are tried first, since what they join need not be
        compared; a set that has come to the largest component by its turn is left
        to those outside, which all look at it.
        """
        anchor = int(np.argmax(self.label == np.bincount(self.label).argmax()))
        asks = np.flatnonzero(self.label != self.label[anchor])
        if not len(asks):
            return
        index, asked = LocalIndex([s[: self.k] for s in self.sets]), np.zeros(len(self.sets), dtype=bool)
        for i in asks.tolist():
            if self.label[i] == self.label[anchor]:
                continue
            need = pair_least(self.sizes, self.sizes[i], self.k, self.num, self.den)
            hits, shared = index.reaching(self.sets[i][: self.k], need, int(own_least(self.sizes[i : i + 1], self.k, self.num, self.den)[0]))
            open_ = ~asked[hits] if low is None else (low[hits] != low[i]) & ~asked[hits]  # a pair is looked at once
            hits = hits[open_][np.argsort(-shared[open_], kind="stable")]
            self.link(i, hits[:4])
            self.link(i, hits[4:])
            asked[i] = True


def block_links(frame: pd.DataFrame, words: int, lower: bool, k: int, num: int, den: int) -> pd.DataFrame:
    """(a, b) classes that link, joining the components ``comp`` of one block, or of two blocks ``side`` where the pair is one of two."""
    frame = frame.sort_values("cid")
    sets = list(shingle_sets(*buffers(pa.array(frame["text"], pa.string())), words, lower))
    own = np.array([len(s) > 0 and class_id(s) == c for s, c in zip(sets, frame["cid"], strict=True)], dtype=bool)  # else two texts share a 64-bit key
    frame, sets = frame[own], [s for s, x in zip(sets, own.tolist(), strict=True) if x]
    if len(sets) < 2:
        return pd.DataFrame({"a": [], "b": []}).astype("int64")
    side = frame["side"].to_numpy()
    two = frame["bi"].iloc[0] != frame["bj"].iloc[0]
    linker = Linker(sets, frame["comp"].to_numpy(), k, num, den)
    if not two:
        linker.neighbours()
    linker.search(side == frame["bi"].iloc[0] if two else None)
    cids = frame["cid"].to_numpy()
    if len(frame) > LARGE:
        give_back()
    return pd.DataFrame({"a": [cids[i] for i, _ in linker.found], "b": [cids[j] for _, j in linker.found]}).astype("int64")


def as_stars(links: pd.DataFrame) -> pd.DataFrame:
    """Links of one block with the same components: each class with the smallest it is joined to, so that a cluster of one block needs no further round."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for a, b in zip(links["a"].tolist(), links["b"].tolist(), strict=True):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    rows = [(x, top) for x in list(root) if (top := find(x)) != x]
    return pd.DataFrame(rows, columns=["a", "b"]).astype("int64")


def near_duplicate_classes(docs: DataFrame, words: int = 5, lower: bool = True, num: int = 85, den: int = 100, k: int = K, short: int = 24, block_shingles: int = 400_000) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, cid, n), and classes (cid, rep, root): root is the smallest class linked, directly or not."""
    spark = docs.sparkSession
    doc_id = F.col("doc_id").cast("long")
    text = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, F.col("text")).alias("rowkey"), "text")
    rows = materialize(text.mapInArrow(partial(_sketches, words=words, lower=lower, k=k), "doc_id long, rowkey long, cid long, n long, sketch array<long>"), "sketches")
    classes = rows.where("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.min("rowkey").alias("rowkey"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = materialize(classes, "classes")

    common = classes.select(F.explode("sketch").alias("g")).groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > short).orderBy(F.desc("n"), "g").limit(MOST_FREQUENT).select("g").toPandas()["g"]
    frequent = spark.sparkContext.broadcast(np.sort(common.to_numpy(np.int64)))
    listed = classes.select("cid", "n", "sketch").mapInArrow(partial(_postings, k=k, num=num, den=den, frequent=frequent), "g long, cid long, n long, rest long, long boolean")
    ordered = listed.where("NOT long").drop("long").repartition("g").sortWithinPartitions("g", "n", "cid")
    pairs = ordered.mapInArrow(partial(_overlaps, num=num, den=den, short=short), "a long, b long, na long, nb long, rest long, tie long")
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("tie").alias("tie"), F.first("na").alias("na"), F.first("nb").alias("nb"), F.max("rest").alias("rest"))
    need = F.when(F.greatest("na", "nb") <= k, F.expr(f"({num}L * (na + nb) + {num + den - 1}) div {num + den}")).otherwise(least_shared(k, num, den))
    likely = pairs.where((F.col("tie") == 1) | (F.col("shared") + F.col("rest") >= need)).select("a", "b")
    ties = _long_lists(listed, num, den)
    clusters = components(likely.union(ties)).select(F.col("node").alias("cid"), F.col("root").alias("cluster"))

    sizes = classes.select("cid", "rowkey", "n").join(clusters, "cid")
    weight = sizes.groupBy("cluster").agg(F.expr(f"(sum(n) + {block_shingles - 1}) div {block_shingles}").cast("int").alias("parts"))
    members = materialize(sizes.join(weight, "cluster").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")), "members")
    wanted = members.select("rowkey")
    if members.count() <= MOST_MEMBERS:
        text = text.join(F.broadcast(wanted), "rowkey", "left_semi")
    texts = text.groupBy("rowkey").agg(F.first("text").alias("text"))  # copies of one row meet as one
    sets = materialize(members.join(texts.hint("merge"), "rowkey").select("cid", "n", "cluster", "parts", "block", "text"), "sets")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return as_stars(block_links(frame, words, lower, k, num, den))

    def linked(dealt: DataFrame, name: str) -> DataFrame:
        return materialize(dealt.select("cid", "text", "comp", "side", "cluster", "bi", "bj").groupBy("cluster", "bi", "bj").applyInPandas(run, "a long, b long"), name)

    links = linked(sets.withColumns({"comp": F.col("cid"), "side": F.col("block"), "bi": F.col("block"), "bj": F.col("block")}), "links")
    large = sets.where("parts > 1")
    if not large.isEmpty():
        links = links.union(_join_blocks(large, links, linked, block_shingles))
    roots = components(links)
    named = classes.select("cid", "rep").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    return rows.select("doc_id", "cid", "n"), named.select("cid", "rep", F.coalesce("root", "cid").alias("root"))


def _join_blocks(sets: DataFrame, links: DataFrame, linked, block_shingles: int) -> DataFrame:
    """Links between blocks of clusters of several blocks: first of the components' representatives, then of members outside the largest component with all."""

    own = sets.select(F.col("cid").alias("a"))

    def placed(links: DataFrame) -> DataFrame:
        links = links.join(own, "a", "left_semi")
        return sets.drop("text").join(components(links).withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("root", "cid")).drop("root")

    def parts(total: str) -> Column:
        return F.expr(f"({total} + {block_shingles - 1}) div {block_shingles}").cast("int")

    heads = placed(links).groupBy("cluster", "block", "comp").agg(F.min(F.struct("cid", "n")).alias("x")).select("cluster", "comp", "x.cid", "x.n")
    dealt = heads.join(heads.groupBy("cluster").agg(parts("sum(n)").alias("parts")), "cluster").withColumn("side", F.pmod(F.xxhash64("comp"), F.col("parts")).cast("int"))
    first = linked(dealt.join(sets.select("cid", "text"), "cid").withColumns({"bi": F.col("side"), "bj": F.col("side")}), "heads")

    now = materialize(placed(links.union(first)), "placed")
    comps = now.groupBy("cluster", "comp").agg(F.sum("n").alias("weight"))
    largest = comps.groupBy("cluster").agg(F.max_by("comp", F.struct("weight", "comp")).alias("largest"), F.sum("weight").alias("weight"), F.max("weight").alias("most"))
    apart = largest.where("weight > most").select("cluster", "largest", parts("weight - most").alias("others"))
    told = now.join(apart, "cluster").withColumn("outside", F.col("comp") != F.col("largest"))
    side = F.when(F.col("outside"), -1 - F.pmod(F.xxhash64("cid"), F.col("others"))).otherwise(F.col("block")).cast("int")
    told = told.withColumn("side", side)
    # outside blocks are numbered from -1 downwards; each meets itself, the other outside blocks and all of the largest component's
    outside = told.where("outside").withColumn("other", F.explode(F.concat(F.sequence(-F.col("others"), F.lit(-1)), F.sequence(F.lit(0), F.col("parts") - 1))))
    inside = told.where("NOT outside").withColumn("other", F.explode(F.sequence(-F.col("others"), F.lit(-1))))
    pairs = outside.unionByName(inside).withColumns({"bi": F.least("side", "other"), "bj": F.greatest("side", "other")})
    return first.union(linked(pairs.join(sets.select("cid", "text"), "cid"), "across"))


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and kept (whether doc_id is that)."""
    rows, classes = near_duplicate_classes(docs, **how)
    least = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = classes.join(least, "root").select("cid", "component_id")
    found = rows.join(named, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
