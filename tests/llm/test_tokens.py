"""op1 and op8 and their encoder."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corrobora.llm.arrowtext import blocks, buffers
from corrobora.llm.bpe import encoder
from corrobora.llm.packing import best_fit, complete_bins, completions, fillings, lower_bound, pack, placements
from corrobora.llm.tokenfile import token_index, tokenize_to_files, write_tokens
from tests.llm.helpers import ODD, docs

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
pieces = st.lists(st.sampled_from(["the", "The", " ", "  ", "\n", "\n\n", "\t", "'s", "don't", ".", "...", "!!", "é", "é", "́", " ", "　", "1", "234", "<|endoftext|>", "<|", "x" * 40, "Σας", "İ", "中文", "🙂", "\x1c", "\x85", "'", "’s", "a'b", "_", "-"]), max_size=30)


@pytest.mark.parametrize("name", [WORD, BYTE])
@settings(max_examples=150, deadline=None)
@given(rows=st.lists(pieces.map("".join), min_size=1, max_size=5))
def test_segments_spell_whole_texts(name, rows):
    own = encoder(name)
    flat, offsets = own.encode(*buffers(pa.array(rows)))
    for i, text in enumerate(rows):
        assert flat[offsets[i] : offsets[i + 1]].tolist() == own.library.encode(text, add_special_tokens=False).ids


def test_encoder_forgets_and_learns_again():
    from corrobora.llm.bpe import SegmentEncoder, vocabulary

    own = SegmentEncoder(vocabulary(BYTE), most=50)
    for k in range(5):
        text = " ".join(f"w{k}x{i}" for i in range(40))
        flat, _ = own.encode(*buffers(pa.array([text])))
        assert flat.tolist() == own.library.encode(text, add_special_tokens=False).ids


def test_blocks_cover_all_rows():
    offsets = np.array([0, 0, 5, 100, 100, 101])
    assert list(blocks(offsets, 10)) == [(0, 2), (2, 3), (3, 5)]
    assert list(blocks(np.array([0]), 10)) == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_plans_place_every_piece(counts):
    for plan in (best_fit(counts, 64), complete_bins(counts, 64)):
        got: dict[int, int] = {}
        for bins, filling in plan:
            assert sum(s * n for s, n in filling) <= 64 and bins > 0
            for s, n in filling:
                got[s] = got.get(s, 0) + bins * n
        assert got == counts
    used = sum(n for n, _ in complete_bins(counts, 64))
    assert used <= sum(n for n, _ in best_fit(counts, 64))
    assert used >= -(-sum(k * v for k, v in counts.items()) // 64)
    assert sum(e - b for _, b, e, *_ in placements(complete_bins(counts, 64))) == sum(counts.values())


def test_bin_completion_beats_best_fit():
    counts = {50: 2, 46: 2, 30: 2, 26: 2, 24: 2, 20: 2, 4: 2}  # fills four bins of 100 exactly
    assert sum(n for n, _ in best_fit(counts, 100)) >= 4
    assert sum(n for n, _ in complete_bins(counts, 100)) == 4


def fewest(items, room):
    best = len(items)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in {b: k for k, b in enumerate(bins)}.values():
            if bins[j] >= items[i]:
                place(i + 1, [*bins[:j], bins[j] - items[i], *bins[j + 1 :]])
        place(i + 1, [*bins, room - items[i]])

    place(0, [])
    return best


def test_few_pieces_are_packed_optimally():
    assert sum(n for n, _ in complete_bins({892: 1, 824: 2, 748: 1, 680: 1, 612: 1, 544: 2, 476: 1}, 2048)) == 3
    rng = np.random.default_rng(5)
    for _ in range(300):
        items = sorted(rng.integers(8, 32, rng.integers(1, 11)).tolist(), reverse=True)
        counts = {s: items.count(s) for s in items}
        plan = complete_bins(counts, 50)
        assert sum(n for n, _ in plan) == fewest(items, 50)
        assert {s: sum(n * dict(f).get(s, 0) for n, f in plan) for s in counts} == counts and all(sum(a * b for a, b in f) <= 50 for _, f in plan)


def test_fillings_hold_an_exact_one_first():
    counts = np.zeros(101, np.int64)
    counts[[40, 30, 20, 10]] = [1, 2, 2, 1]
    assert fillings(counts, 60, 3, 100)[0] in (((40, 1), (20, 1)), ((30, 2),))


def brute_pieces(rows, capacity=2048):
    own, out = encoder(BYTE), []
    for i, text in rows:
        ids = own.library.encode(text or "", add_special_tokens=False).ids + [0]
        cut = len(ids) % capacity or capacity
        edges = [0, *range(cut, len(ids) + 1, capacity)]
        for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            out.append((i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return out


def test_packing_places_all_pieces_gaplessly(spark):
    rng = random.Random(1)
    rows = ODD + [(10 + i, " ".join(rng.choice(["the", "of", "thing", "x1"]) for _ in range(rng.randrange(1, 3000)))) for i in range(60)]
    got = [tuple(r) for r in pack(docs(spark, rows)).collect()]
    assert sorted((r[:5] for r in got), key=str) == sorted(brute_pieces(rows), key=str)
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r[5], []).append((r[6], r[3]))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) - -(-sum(r[3] for r in got) // 2048) <= 1


def test_empty_tables(spark):
    empty = docs(spark, []) if False else spark.createDataFrame([], "doc_id long, text string, extra string")
    assert pack(empty).count() == 0
    assert tokenize_to_files(empty).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    rows = ODD + [(100 - i, f"Number {i} of these, it's {'so ' * i}.") for i in range(50)]
    path = f"file://{tmp_path}/tokens"
    write_tokens(docs(spark, rows), path, files=4)
    got = token_index(spark, path).collect()
    own, at, want = encoder(WORD), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*own.library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_token_files_have_page_indexes_and_small_row_groups(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    rng = random.Random(0)
    rows = [(i, " ".join(rng.choice("abcdefghij") * rng.randrange(1, 9) for _ in range(300))) for i in range(400)]
    write_tokens(docs(spark, rows), f"file://{tmp_path}/t", files=1, row_group_bytes=64 << 10, page_bytes=8 << 10)
    file = pq.ParquetFile(glob.glob(f"{tmp_path}/t/*.parquet")[0])
    assert file.metadata.num_row_groups > 1
    column = file.metadata.row_group(0).column(file.schema_arrow.names.index("doc_id"))
    assert column.has_column_index and column.has_offset_index
    assert any("DELTA" in x or "DICTIONARY" in x for x in column.encodings)


@pytest.mark.parametrize("name", [WORD, BYTE])
@settings(max_examples=60, deadline=None)
@given(rows=st.lists(pieces.map("".join), min_size=1, max_size=5))
def test_ids_are_the_untouched_librarys(name, rows):
    from tokenizers import Tokenizer

    from corrobora.llm.bpe import vocabulary

    flat, offsets = encoder(name).encode(*buffers(pa.array(rows)))
    plain = _plain.setdefault(name, Tokenizer.from_file(vocabulary(name)))
    for i, text in enumerate(rows):
        assert flat[offsets[i] : offsets[i + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids


_plain: dict = {}


def test_special_strings_can_be_ordinary_text():
    text = "a <|endoftext|> b"
    special, plain = (encoder(BYTE, as_text).encode(*buffers(pa.array([text])))[0].tolist() for as_text in (False, True))
    assert 50256 in special and 50256 not in plain


def test_a_thousand_histograms_are_packed_optimally_and_bounds_hold():
    rng = np.random.default_rng(11)
    for _ in range(1000):
        low, high = sorted(rng.integers(5, 70, 2).tolist())
        items = sorted(rng.integers(low, high + 1, rng.integers(1, 11)).tolist(), reverse=True)
        counts = {s: items.count(s) for s in items}
        want = fewest(items, 100)
        assert lower_bound(counts, 100) <= want == sum(n for n, _ in complete_bins(counts, 100))


def test_pieces_that_cannot_share_prove_the_bound():
    counts = {s: 5 for s in range(513, 683)}
    assert lower_bound(counts, 2048) == -(-5 * 170 // 3) > -(-sum(s * n for s, n in counts.items()) // 2048)
    assert lower_bound({60: 3, 50: 1, 45: 2}, 100) == 5 and lower_bound({}, 100) == 0


def test_completions_are_the_undominated_ones():
    def full(left, room):
        if not left:
            return [()]
        (s, n), *rest = left
        return [((s, k), *f) if k else f for k in range(min(n, room // s) + 1) for f in full(rest, room - k * s)]

    for left, room in (([[50, 1], [30, 2], [20, 2], [10, 1]], 60), ([[40, 1], [21, 2], [20, 1], [7, 3]], 62), ([[9, 2], [5, 3], [4, 3]], 13)):
        found = completions(left, room, [10_000])
        every = full(left, room)
        assert set(found) <= set(every)
        if [room, 1] not in left:
            best = min(room - sum(s * k for s, k in f) for f in every)
            assert room - sum(s * k for s, k in found[0]) == best
        for f in found:  # nothing left can be added, or take the place of smaller pieces of less room
            rest, have = room - sum(s * k for s, k in f), dict(f)
            assert not any(have.get(s, 0) < n and s <= rest for s, n in left)


def test_equal_rows_are_packed_and_written_apart(spark, tmp_path):
    rows = [(7, "same words here")] * 300 + [(i, "other") for i in range(20)]
    got = pack(docs(spark, rows)).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(rows)
    path = f"file://{tmp_path}/t"
    write_tokens(docs(spark, rows), path, files=4)
    index = sorted(map(tuple, token_index(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in index] == sorted(i for i, _ in rows) and [r[1] for r in index] == [0, *np.cumsum([r[2] for r in index])[:-1].tolist()]
    sizes = [r[0] for r in spark.read.parquet(path).groupBy("part").count().select("count").collect()]
    assert max(sizes) < 200
