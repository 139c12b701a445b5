"""Quality rules by repetition coverage.

Words are hashed from the text's bytes, n-grams of all lengths by one rolling
hash over the words (a prefix sum of hashes times powers), all in numpy over
blocks of documents. For each n the rule measures the characters of
words that lie in an n-gram equal to an earlier one of the document; for lines,
the characters of lines equal to an earlier one. A first occurrence does not
count, so a heading said again at a text's end costs it once. Longer n-grams
are looked for only where the shorter ones inside them repeat, which loses
none.

Defined results: a null or empty text has no words and fails; a null doc_id is
kept; rows are judged one by one, so ties and repeated rows change nothing; an
empty table gives no rows; other columns are not read. No row is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.llm.arrowtext import NON_SPACE, Rolling, blocks, buffers, code_points, gives_back, mix64, span_hashes, spans

#: Largest share of word characters inside repeated n-grams, for each n (Rae et al. 2021, table A1).
NGRAM_SHARE: Mapping[int, float] = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of characters in lines equal to an earlier one, and of such lines.
LINE_CHARS_SHARE, LINE_SHARE = 0.20, 0.30

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NOT_NEWLINE = np.ones(256, dtype=bool)
_NOT_NEWLINE[0x0A] = False


def _twice(keys: np.ndarray) -> np.ndarray:
    """Which entries have an equal one."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _again(keys: np.ndarray) -> np.ndarray:
    """Which entries equal an earlier one."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return out


def measure(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """All measures of a block of documents, one entry per document."""
    n = len(offsets) - 1
    points = code_points(data)
    starts, ends, first = spans(data, offsets, NON_SPACE)
    chars = np.concatenate([[0], np.cumsum(points[ends] - points[starts])])
    out = {"n_words": np.diff(first), "word_chars": chars[first[1:]] - chars[first[:-1]]}
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    out["n_symbols"] = symbols[offsets[1:]] - symbols[offsets[:-1]]
    doc = np.repeat(np.arange(n), np.diff(first))
    salt = mix64(np.arange(n, dtype=np.uint64) + np.uint64(1))
    hashes = span_hashes(data, starts, ends)
    rolling = Rolling(hashes, max(3, *lengths))

    def repeated(k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts, among ``at``, of k-word windows that occur twice or more in their document, and the windows' keys."""
        at = at[at + k <= len(hashes)]
        at = at[doc[at] == doc[at + k - 1]]
        if not len(at):
            return at, np.zeros(0, np.uint64)
        keys = rolling.windows(k, at) ^ salt[doc[at]]
        twice = _twice(keys)
        return at[twice], keys[twice]

    def covered(k: int, at: np.ndarray) -> np.ndarray:
        edge = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + k, -1)
        return np.cumsum(edge)[:-1] > 0

    def by_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[bounds[1:]] - total[bounds[:-1]]

    at, _ = repeated(3, np.arange(len(hashes)))
    out["n_repeat_words"] = by_doc(covered(3, at), first)
    word_chars = np.diff(chars)
    for k in lengths:
        at, keys = repeated(k, at)
        out[f"dup_{k}gram_chars"] = by_doc(np.where(covered(k, at[_again(keys)]), word_chars, 0), first)
    line_starts, line_ends, line_first = spans(data, offsets, _NOT_NEWLINE)
    solid = np.concatenate([[0], np.cumsum(NON_SPACE[data])])
    full = solid[line_ends] > solid[line_starts]
    line_starts, line_ends = line_starts[full], line_ends[full]
    line_first = np.searchsorted(line_starts, offsets, "left")
    line_doc = np.repeat(np.arange(n), np.diff(line_first))
    again = _again(span_hashes(data, line_starts, line_ends) ^ salt[line_doc])
    line_chars = points[line_ends] - points[line_starts]
    out["n_lines"] = np.diff(line_first)
    out["n_dup_lines"] = by_doc(again, line_first)
    out["line_chars"] = by_doc(line_chars, line_first)
    out["dup_line_chars"] = by_doc(np.where(again, line_chars, 0), line_first)
    return out


def verdicts(m: dict[str, np.ndarray], shares: Mapping[int, float], line_chars_share: float, line_share: float) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) of each document."""
    base = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    bad = (m["dup_line_chars"] > line_chars_share * m["line_chars"]) | (m["n_dup_lines"] > line_share * m["n_lines"])
    for k, share in shares.items():
        bad |= m[f"dup_{k}gram_chars"] > share * m["word_chars"]
    return base, ~base & ~bad


def _columns(shares: Mapping[int, float]) -> list[str]:
    return ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(f"dup_{k}gram_chars" for k in shares), "dup_line_chars"]


@gives_back
def _judge(batches: Iterator[pa.RecordBatch], shares: Mapping[int, float], line_chars_share: float, line_share: float, keep_rows: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for i, j in blocks(offsets):
            m = measure(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tuple(shares))
            base, kept = verdicts(m, shares, line_chars_share, line_share)
            if keep_rows:
                yield batch.slice(i, j - i).filter(pa.array(kept))
                continue
            numbers = [pa.array(m[c].astype(np.int64)) for c in _columns(shares)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *numbers, pa.array(base), pa.array(kept)], ["doc_id", *_columns(shares), "base_failed", "kept"])


def quality_report(docs: DataFrame, shares: Mapping[int, float] = NGRAM_SHARE, line_chars_share: float = LINE_CHARS_SHARE, line_share: float = LINE_SHARE) -> DataFrame:
    """Measures and verdict of every document."""
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _columns(shares)) + ", base_failed boolean, kept boolean"
    run = partial(_judge, shares=dict(shares), line_chars_share=line_chars_share, line_share=line_share, keep_rows=False)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, shares: Mapping[int, float] = NGRAM_SHARE, line_chars_share: float = LINE_CHARS_SHARE, line_share: float = LINE_SHARE) -> DataFrame:
    """The documents that pass, with all their columns."""
    run = partial(_judge, shares=dict(shares), line_chars_share=line_chars_share, line_share=line_share, keep_rows=True)
    return docs.mapInArrow(run, docs.schema)
