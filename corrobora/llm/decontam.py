"""Benchmark decontamination by a stored positional inverted index.

1. The benchmark's windows (``width`` consecutive words of an item, or a shorter
   item whole) are made on the executors and written: one row for each item and
   window, of term hashes.
2. The index is distributed by document: for each block of documents one row is
   written that holds, for every term of the benchmark, the ascending list of its
   token positions in the block, with the documents' borders. Texts are read
   and cut into words once, whatever the size of the benchmark; a row is smaller
   than its texts. No posting is shuffled and no document meets another, so hot
   sources, copies or frequent terms cost no more than their length.
3. A window's search starts from the list of its rarest term in the block,
   shifts it by the term's offset in the window, and intersects it with the
   other terms' lists, from rarer to more frequent ones, by binary search: what
   is left are the exact occurrences. With ``slop`` above 0 proximity matches are
   found in the same way: places at which every term stands within ``slop``
   positions of its own, in any order of looking.

Windows go to the executors in passes of at most ``pass_rows`` rows, so that the
broadcast is bounded by what is built of it (``width`` hashes and an item for each row);
each further pass reads the index again, not the texts, and its hits are united
with those of the others.

Defined results: a null or empty text has no words and is not contaminated; a
null item text is no item; a null item_id is written as the string ``null``;
equal windows of several items name all of them; repeated rows get repeated
results; an empty benchmark hits nothing; extra columns, whatever their names, are kept by
``drop_contaminated`` and not read by ``contamination_report``. Documents to drop
are told by a 64-bit hash of their text, so copies share their fate.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.llm.arrowtext import ALNUM, blocks, buffers, gives_back, span_hashes, spans
from corrobora.llm.durable import materialize, new_path

INDEX = "block long, doc_ids array<long>, keys array<long>, borders array<int>, terms array<long>, starts array<int>, positions array<int>"
FOUND = "block long, place int, doc_id long, key long, n_words long, hits array<struct<low:int,high:int>>, items array<string>, near array<string>"

#: Windows' rows of a pass; terms that are broadcast to choose what is indexed (more: every term is).
PASS_ROWS, MOST_TERMS = 200_000, 8_000_000
#: Contaminated texts' keys that may be broadcast.
MOST_KEYS = 2_000_000


def item_windows(text: str, width: int) -> list[list[int]]:
    """The windows of an item as lists of term hashes."""
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = spans(raw, np.array([0, len(raw)]), ALNUM)
    words = span_hashes(raw, starts, ends, lower=True).view(np.int64).tolist()
    return [words[i : i + width] for i in range(max(1, len(words) - width + 1) if words else 0)]


class Windows:
    """Distinct windows of benchmark items, as numbers of their terms, and the items that have them."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        rows = [(item, w) for item, text in items for w in item_windows(text, width)]
        self._build([r[0] for r in rows], [r[1] for r in rows], width)

    @classmethod
    def of_rows(cls, items: list[str], terms: list[list[int]], width: int) -> "Windows":
        own = cls.__new__(cls)
        own._build(items, terms, width)
        return own

    def _build(self, items: list[str], terms: list[list[int]], width: int) -> None:
        size = np.array([len(x) for x in terms], np.int64)
        flat = np.fromiter((w for x in terms for w in x), np.int64, int(size.sum())).view(np.uint64)
        self.terms, number = np.unique(flat, return_inverse=True)
        table = np.full((len(terms), width), -1, np.int64)
        table[np.arange(width)[None, :] < size[:, None]] = number
        self.table, own = np.unique(table, axis=0, return_inverse=True) if len(terms) else (table, np.zeros(0, np.int64))
        self.size = (self.table >= 0).sum(axis=1)
        self.names, named = np.unique(np.array(items, dtype=object).astype(str), return_inverse=True) if items else (np.zeros(0, str), np.zeros(0, np.int64))
        order = np.argsort(own.ravel(), kind="stable")
        self.item, self.first = named[order], np.searchsorted(own.ravel()[order], np.arange(len(self.table) + 1))

    def items_of(self, windows: list[int]) -> list[str]:
        return sorted({str(self.names[i]) for w in windows for i in self.item[self.first[w] : self.first[w + 1]].tolist()})


class PositionalIndex:
    """Ascending positions of each term in a block of documents, whose borders are positions too."""

    def __init__(self, words: np.ndarray, first: np.ndarray, terms: np.ndarray | None):
        """words: hashes in a row; first: where documents begin, and the end; terms: those that are kept, sorted, or None for all."""
        known = np.arange(len(words))
        if terms is not None:
            at = np.searchsorted(terms, words)
            at[at == len(terms)] = 0
            known = np.flatnonzero(terms[at] == words) if len(terms) else known[:0]
        order = known[np.argsort(words[known], kind="stable")]
        sorted_ = words[order]
        edge = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(order) else np.zeros(0, np.int64)
        self._fill(sorted_[edge], np.append(edge, len(order)), order, np.asarray(first))

    @classmethod
    def of_lists(cls, terms: np.ndarray, starts: np.ndarray, positions: np.ndarray, borders: np.ndarray) -> "PositionalIndex":
        own = cls.__new__(cls)
        own._fill(terms, starts, positions, borders)
        return own

    def _fill(self, terms: np.ndarray, starts: np.ndarray, positions: np.ndarray, borders: np.ndarray) -> None:
        self.terms, self.starts, self.positions, self.borders = terms, starts, positions, borders

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.borders) - 1), np.diff(self.borders))

    def _candidates(self, windows: Windows, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(windows, positions of their rarest terms, documents) with the windows' list numbers and offsets by rarity, some at a time."""
        if not len(windows.size) or not len(self.positions):
            return
        at = np.searchsorted(self.terms, windows.terms)
        at[at == len(self.terms)] = 0
        number = np.where(self.terms[at] == windows.terms, at, -2)
        table = np.where(windows.table >= 0, number[windows.table], -1)
        whole = np.flatnonzero(~(table == -2).any(axis=1))
        table = table[whole]
        if not len(whole):
            return
        length = np.diff(self.starts)
        counts = np.where(table >= 0, length[table], np.iinfo(np.int64).max)
        rarity = np.argsort(counts, axis=1, kind="stable")
        lists = np.take_along_axis(table, rarity, axis=1)
        n = counts[np.arange(len(counts)), rarity[:, 0]]
        bounds = np.concatenate([[0], np.cumsum(n)])
        i = 0
        while i < len(n):
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
            own = np.repeat(np.arange(i, j), n[i:j])
            inside = np.arange(len(own)) - np.repeat(bounds[i:j] - bounds[i], n[i:j])
            place = self.positions[self.starts[lists[own, 0]] + inside].astype(np.int64)
            yield whole[own], place, np.searchsorted(self.borders, place, "right") - 1, lists[own], rarity[own]
            i = j

    def _code(self) -> np.ndarray:
        """All lists in one ascending array: the list's number times the block's length, and the position."""
        return np.repeat(np.arange(len(self.terms)) * self._span, np.diff(self.starts)) + self.positions

    @property
    def _span(self) -> int:
        return int(self.borders[-1]) + 1

    def exact(self, windows: Windows, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """(window, first position) of every exact occurrence."""
        out, code = [], self._code()
        for window, place, doc, lists, offsets in self._candidates(windows, most):
            place = place - offsets[:, 0]
            ok = (place >= self.borders[doc]) & (place + windows.size[window] <= self.borders[doc + 1])
            for k in range(1, windows.table.shape[1]):
                window, place, lists, offsets = window[ok], place[ok], lists[ok], offsets[ok]
                want = lists[:, k] * self._span + place + offsets[:, k]
                ok = (lists[:, k] < 0) | (code[np.minimum(np.searchsorted(code, want), len(code) - 1)] == want)
            out.append((window[ok], place[ok]))
        return (np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])) if out else (np.zeros(0, np.int64),) * 2

    def near(self, windows: Windows, slop: int, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """(window, a position of its rarest term) of every proximity match: at some place each term of the window stands within ``slop`` of its own, in one document."""
        out, code = [], self._code()
        for window, at, doc, lists, offsets in self._candidates(windows, most // (2 * slop + 1)):
            for shift in range(-slop, slop + 1):
                w, a, d, own, off = window, at, doc, lists, offsets
                place = at - off[:, 0] + shift
                for k in range(1, windows.table.shape[1]):
                    base, expected = own[:, k] * self._span, place + off[:, k]
                    low, high = base + np.maximum(expected - slop, self.borders[d]), base + np.minimum(expected + slop, self.borders[d + 1] - 1)
                    found = np.searchsorted(code, low)
                    ok = (own[:, k] < 0) | ((code[np.minimum(found, len(code) - 1)] <= high) & (found < len(code)) & (low <= high))
                    w, a, d, own, off, place = w[ok], a[ok], d[ok], own[ok], off[ok], place[ok]
                out.append((w, a))
        return (np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])) if out else (np.zeros(0, np.int64),) * 2


# --- the stored tables -----------------------------------------------------------


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One list as a column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


@gives_back
def _windows_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, w) for i, t in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for w in item_windows(t, width)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["item", "terms"])


def window_table(benchmark: DataFrame, width: int) -> DataFrame:
    """(item, terms): each window of each item once, written."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    return materialize(items.mapInArrow(partial(_windows_of, width=width), "item string, terms array<long>").distinct(), "windows")


@gives_back
def _index(batches: Iterator[pa.RecordBatch], terms) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    kept, number = terms.value if terms is not None else None, TaskContext.get().partitionId() << 32
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for i, j in blocks(offsets):
            block, rows = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            starts, ends, first = spans(block, rows, ALNUM)
            own = PositionalIndex(span_hashes(block, starts, ends, lower=True), first, kept)
            part = batch.slice(i, j - i)
            ids, keys = (pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), pa.concat_arrays([part.column(c)])) for c in ("doc_id", "key"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), ids, keys, _lists(first.astype(np.int32), pa.int32()), _lists(own.terms.view(np.int64), pa.int64()), _lists(own.starts.astype(np.int32), pa.int32()), _lists(own.positions.astype(np.int32), pa.int32())],
                ["block", "doc_ids", "keys", "borders", "terms", "starts", "positions"],
            )
            number += 1


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def positional_index(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """The index of the documents for the terms of the windows, written once."""
    spark = docs.sparkSession
    terms = windows.select(F.explode("terms").alias("t")).distinct()
    kept = None
    if terms.count() <= MOST_TERMS:  # 8 bytes each; else every term is indexed
        kept = spark.sparkContext.broadcast(np.sort(terms.toArrow().column("t").to_numpy().view(np.uint64)))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("key"))
    path = new_path(spark, "positions")
    slim.mapInArrow(partial(_index, terms=kept), INDEX).write.option("parquet.writer.version", "v2").option("compression", "zstd").parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def _merged(low: np.ndarray, high: np.ndarray) -> list[dict[str, int]]:
    """The union of intervals, in order."""
    out: list[dict[str, int]] = []
    for a, b in sorted(zip(low.tolist(), high.tolist(), strict=True)):
        if out and a <= out[-1]["high"]:
            out[-1]["high"] = max(out[-1]["high"], b)
        else:
            out.append({"low": a, "high": b})
    return out


@gives_back
def _search(batches: Iterator[pa.RecordBatch], windows, slop: int) -> Iterator[pa.RecordBatch]:
    """For each document of a block: intervals of words hit (from the document's first), items found exactly and nearly."""
    windows = windows.value
    for batch in batches:
        for r in range(len(batch)):
            ids, keys, borders, terms, starts, positions = (batch.column(c)[r].values for c in ("doc_ids", "keys", "borders", "terms", "starts", "positions"))
            borders = borders.to_numpy().astype(np.int64)
            own = PositionalIndex.of_lists(terms.to_numpy().view(np.uint64), starts.to_numpy().astype(np.int64), positions.to_numpy(), borders)
            n = len(ids)
            hits: list[list] = [[]] * n
            items: list[list] = [[]] * n
            near: list[list] = [[]] * n
            window, low = own.exact(windows)
            if len(window):
                doc = np.searchsorted(borders, low, "right") - 1
                order = np.argsort(doc, kind="stable")
                window, low, doc = window[order], low[order], doc[order]
                edges = np.append(np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])), len(doc))
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    d, own_low = int(doc[a]), low[a:b] - borders[doc[a]]
                    hits[d] = _merged(own_low, own_low + windows.size[window[a:b]])
                    items[d] = windows.items_of(np.unique(window[a:b]).tolist())
            if slop:
                window, at = own.near(windows, slop)
                doc = np.searchsorted(borders, at, "right") - 1
                for d in np.unique(doc).tolist():
                    near[d] = windows.items_of(np.unique(window[doc == d]).tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, batch.column("block")[r].as_py(), np.int64)), pa.array(np.arange(n, dtype=np.int32)), pa.concat_arrays([ids]), pa.concat_arrays([keys]), pa.array(np.diff(borders)),
                    pa.array(hits, pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))), pa.array(items, pa.list_(pa.string())), pa.array(near, pa.list_(pa.string())),
                ],
                ["block", "place", "doc_id", "key", "n_words", "hits", "items", "near"],
            )


def search(index: DataFrame, windows: DataFrame, width: int, slop: int, pass_rows: int) -> DataFrame:
    """``FOUND`` for each document of the index, over all windows."""
    spark, found = index.sparkSession, None
    passes = max(1, -(-windows.count() // pass_rows))
    for k in range(passes):
        part = (windows.where(F.pmod(F.xxhash64("item", "terms"), F.lit(passes)) == k) if passes > 1 else windows).toArrow()
        own = spark.sparkContext.broadcast(Windows.of_rows(part.column("item").to_pylist(), part.column("terms").to_pylist(), width))
        got = index.mapInArrow(partial(_search, windows=own, slop=slop), FOUND)
        if passes > 1:
            got = materialize(got, "found")
        found = got if found is None else found.unionByName(got)
    if passes == 1:
        return found
    first = [F.first(c).alias(c) for c in ("doc_id", "key", "n_words")]
    lists = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("items", "near")]  # one list a pass
    return found.groupBy("block", "place").agg(*first, F.flatten(F.collect_list("hits")).alias("hits"), *lists)


def words_hit(hits: Column) -> Column:
    """Words in the union of intervals."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = F.aggregate(F.array_sort(hits), zero, lambda s, x: F.struct(F.greatest(s["end"], x["high"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["high"] - F.greatest(s["end"], x["low"]))).alias("n")))
    return step["n"].cast("long")


def _scan(docs: DataFrame, benchmark: DataFrame, width: int, slop: int, pass_rows: int) -> DataFrame:
    windows = window_table(benchmark, width)
    return search(positional_index(docs, windows), windows, width, slop, pass_rows)


def contamination_report(docs: DataFrame, benchmark: DataFrame, width: int = 10, slop: int = 0, pass_rows: int = PASS_ROWS) -> DataFrame:
    """Words, hit words and items found, for each document; with ``slop`` also ``near_items``, those with an exact or a proximity match."""
    found = _scan(docs, benchmark, width, slop, pass_rows)
    items = F.array_sort("items")
    columns = [
        "doc_id", "n_words", words_hit(F.col("hits")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"),
    ]
    return found.select(*columns, *([F.size("near").cast("long").alias("near_items")] if slop else []))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, pass_rows: int = PASS_ROWS) -> DataFrame:
    """The documents, with all their columns, in which no window of an item occurs."""
    names = docs.columns
    own = docs.toDF(*[n if n in ("doc_id", "text") else f"c{i}" for i, n in enumerate(names)])
    found = _scan(own, benchmark, width, 0, pass_rows).where(F.size("items") > 0)
    bad = materialize(found.select(F.col("key").alias("bad_key")).distinct(), "contaminated")
    few = bad.count() <= MOST_KEYS
    keyed = own.withColumn("bad_key", text_key())
    return keyed.join(F.broadcast(bad) if few else bad, "bad_key", "left_anti").drop("bad_key").toDF(*names)
