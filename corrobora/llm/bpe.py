"""Token ids by the tokenizers library, each distinct segment encoded once.

A segment is a run of ASCII white space with the run of other bytes after it,
cut again where an ASCII letter meets an ASCII punctuation mark other than the
apostrophe. The pre-tokenizers of the supported vocabularies never join
characters across such borders (tests hold this against whole texts), so a
text's ids are its segments' ids in a row. A worker keeps the ids of the segments it has met, up
to a bound, and hands the library only new ones. Texts for which the borders
might not hold (white space outside ASCII, control characters, strings of
special tokens) are encoded whole. Special tokens' strings in texts get the
special ids, as the library does unless told otherwise; ``special_as_text``
makes them ordinary text.
"""

from __future__ import annotations

import numpy as np

from corrobora.llm.arrowtext import NON_SPACE, span_hashes

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_MARK[0x27] = False
#: Bytes that may begin something for which the borders might not hold.
_SUSPECT = np.zeros(256, dtype=bool)
_SUSPECT[[*range(0x09), *range(0x0E, 0x20), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3, 0x3C, 0xCC, 0xCD]] = True
#: Bytes outside ASCII and the Latin letters of two bytes that stay two bytes in lower case and under composition (0xC3).
_STRANGE = np.zeros(256, dtype=bool)
_STRANGE[0x80:] = True
_STRANGE[[*range(0x80, 0xC0), 0xC3]] = False
#: White space that may begin a segment encoded with others.
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, 0x0A, 0x09, 0x0D]] = True
#: Segments handed to the library as one string, and at once: what it returns takes far more room than the ids.
_JOINED, _AT_ONCE = 256, 16_384
#: Bytes of text encoded at once (a longer text is a block of its own).
ENCODED_BYTES = 1 << 20

_OPEN: dict[tuple, "SegmentEncoder"] = {}


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file by its name; a path is returned as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encoder(name: str, special_as_text: bool = False) -> "SegmentEncoder":
    """One encoder per worker and vocabulary."""
    if (name, special_as_text) not in _OPEN:
        _OPEN[name, special_as_text] = SegmentEncoder(vocabulary(name), special_as_text=special_as_text)
    return _OPEN[name, special_as_text]


class SegmentEncoder:
    """Encodes rows of UTF-8 bytes to flat ids. ``most`` bounds the segments kept."""

    def __init__(self, path: str, most: int = 1_000_000, special_as_text: bool = False):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        self.most = most
        self.spelled, self.spaced = None, self.library.normalizer is None
        suffix = getattr(self.library.model, "end_of_word_suffix", None) or ""
        if self.spaced or suffix:
            vocab = self.library.get_vocab()
            self.spelled = np.zeros(max(vocab.values()) + 1, np.int64)
            for token, i in vocab.items():
                self.spelled[i] = len(token) - (len(suffix) if suffix and token.endswith(suffix) else 0)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Adds segments. Where the library's tokens spell the bytes of their text, many are encoded as one string and cut by length."""
        spelt = ends - starts
        joined = np.zeros(len(keys), dtype=bool)
        if self.spelled is not None:
            joined = _GAP[data[starts]] & NON_SPACE[data[ends - 1]]
            if not self.spaced:  # white space has no token, and only bytes that a normalizer leaves in number count
                solid, strange = (np.concatenate([[0], np.cumsum(of[data], dtype=np.int64)]) for of in (NON_SPACE, _STRANGE))
                spelt = solid[ends] - solid[starts]
                joined &= strange[ends] == strange[starts]
        size, order, flat, raw = np.zeros(len(keys), np.int64), [], [], data.tobytes()
        for many in (False, True):
            own = np.flatnonzero(joined == many)
            for i in range(0, len(own), _AT_ONCE):
                some = own[i : i + _AT_ONCE]
                ids, size[some] = self._joined(data, starts[some], ends[some], spelt[some]) if many else self._each(raw, starts[some], ends[some])
                order.append(some)
                flat.append(ids)
        order, flat = np.concatenate(order), np.concatenate(flat)
        keys, size = keys[order], size[order]
        first = np.cumsum(size) - size + len(self.flat)
        sort = np.argsort(keys)
        keys, first, size = keys[sort], first[sort], size[sort]
        at = np.searchsorted(self.keys, keys) + np.arange(len(keys))
        old = np.ones(len(self.keys) + len(keys), dtype=bool)
        old[at] = False
        for name, new in (("keys", keys), ("first", first), ("size", size)):
            both = np.empty(len(old), new.dtype)
            both[at], both[old] = new, getattr(self, name)
            setattr(self, name, both)
        self.flat = np.concatenate([self.flat, flat])

    def _each(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all segments in a row, and how many each has."""
        found = self._encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((y for x in found for y in x), np.uint32, int(size.sum())), size

    def _joined(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, spelt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of segments whose tokens spell so many bytes each, from strings of many."""
        length = ends - starts
        edges = np.concatenate([[0], np.cumsum(length)])
        raw = data[np.repeat(starts - edges[:-1], length) + np.arange(edges[-1])].tobytes()
        cuts = [*edges[:-1:_JOINED].tolist(), int(edges[-1])]
        found = self._encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)])
        ids = np.concatenate([np.asarray(x, np.uint32) for x in found])
        want, have = np.cumsum(spelt), np.cumsum(self.spelled[ids])
        last = np.searchsorted(have, want) + 1
        if len(have) and last[-1] <= len(have) and np.array_equal(have[last - 1], want):
            return ids, np.diff(last, prepend=0)
        return self._each(data.tobytes(), starts, ends)  # a token reaches over a segment's border
    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in a row, and the n + 1 offsets of the rows in them."""
        odd = self._odd(data, offsets)
        solid = NON_SPACE[data]
        start = np.zeros(len(data) + 1, dtype=bool)
        if len(data):
            letter, mark = _LETTER[data], _MARK[data]
            start[1:-1] = (~solid[1:] & solid[:-1]) | (letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])
            start[offsets] = True
            start[-1] = True
        edges = np.flatnonzero(start)
        starts, ends = edges[:-1], edges[1:]
        row_first = np.searchsorted(starts, offsets, "left")
        keys = span_hashes(data, starts, ends)
        unique, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
        known = self._known(unique)
        if not known.all():
            if odd.any():  # segments of odd rows are not needed
                row = np.searchsorted(offsets, starts, "right") - 1
                plain = np.zeros(len(unique), dtype=bool)
                plain[inverse[~odd[row]]] = True
                known |= ~plain
            new = np.flatnonzero(~known)
            if len(self.keys) + len(new) > self.most:
                self._clear()
                new = np.flatnonzero(plain) if odd.any() else np.arange(len(unique))
            if len(new):
                self._learn(unique[new], data, starts[at[new]], ends[at[new]])
        where = np.searchsorted(self.keys, unique)
        where[where == len(self.keys)] = 0
        size, first = (self.size[where], self.first[where]) if len(self.keys) else (np.zeros(len(unique), np.int64),) * 2
        lengths, begins = size[inverse], first[inverse]
        if odd.any():
            row = np.searchsorted(offsets, starts, "right") - 1
            lengths = np.where(odd[row], 0, lengths)
        total = np.concatenate([[0], np.cumsum(lengths)])
        flat = self.flat[np.repeat(begins - total[:-1], lengths) + np.arange(total[-1])]
        rows = total[row_first]
        return self._with_odd(data, offsets, odd, flat, rows) if odd.any() else (flat, rows)

    def _known(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), dtype=bool)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return self.keys[at] == keys

    def _odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows with white space or controls outside the plain ones, or with a special token's opening."""
        n = len(offsets) - 1
        odd = np.zeros(n, dtype=bool)
        if not len(data):
            return odd
        at = np.flatnonzero(_SUSPECT[data])
        if not len(at):
            return odd
        c = data[at]
        nxt = np.where(at + 1 < len(data), data[np.minimum(at + 1, len(data) - 1)], 0)
        nxt2 = np.where(at + 2 < len(data), data[np.minimum(at + 2, len(data) - 1)], 0)
        bad = (c < 0x20) | (c == 0x7F)
        bad |= (c == 0xC2) & ((nxt == 0x85) | (nxt == 0xA0))
        bad |= ((c == 0xE1) & (nxt == 0x9A) & (nxt2 == 0x80)) | ((c == 0xE3) & (nxt == 0x80) & (nxt2 == 0x80))
        bad |= (c == 0xE2) & ((nxt == 0x80) | (nxt == 0x81)) & ((nxt2 <= 0x8F) | (nxt2 == 0xA8) | (nxt2 == 0xA9) | (nxt2 == 0xAF) | (nxt2 == 0x9F))
        bad |= (c == 0x3C) & (nxt == 0x7C)
        # a combining mark (U+0300 to U+036F) may join what is before it
        bad |= (c == 0xCC) | (c == 0xCD)
        odd[np.searchsorted(offsets, at[bad], "right") - 1] = True
        return odd

    def _with_odd(self, data, offsets, odd, flat, rows):
        raw, parts, sizes = data.tobytes(), [], np.diff(rows)
        whole = dict(zip(np.flatnonzero(odd).tolist(), self._encode([raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace") for i in np.flatnonzero(odd)]), strict=True))
        done = 0
        for i, ids in whole.items():
            parts += [flat[rows[done] : rows[i]], np.asarray(ids, np.uint32)]
            sizes[i], done = len(ids), i + 1
        parts.append(flat[rows[done] :])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])
