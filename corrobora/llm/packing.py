"""Best-fit packing by bin completion.

Sequences hold at most ``capacity`` tokens, so whatever the corpus, packing
depends only on how many pieces there are of each of ``capacity`` lengths.
That histogram (at most ``capacity`` rows) is all the driver sees. It is packed
there by bin completion: take the largest length left and fill the room beside
it. The best-fit-decreasing packing is the first incumbent; where it meets the
lower bound (tokens, pieces that cannot share, Martello and Toth's L2) it is
optimal. Else ``FEW`` pieces or less are packed by branch and bound, depth first
with a stack over all undominated fillings, which ends at the bound, with its
tree searched through, or after ``STEPS`` steps of enumeration, a twentieth of
them at most in one room. While more pieces are left, descents are greedy: each
takes the fullest filling found (as often as the counts allow), but for one
departure, until ``FEW`` are left to be searched. So ``FEW`` pieces or less are
packed optimally unless the steps run out; of more, the number of sequences is
at most that of best fit decreasing, and ``least_sequences`` in each row tells
the lower bound, so the gap is known. The result is a short list of (filling,
repetitions). Pieces then find their place by their rank among the pieces of
their length.

Ranks are counted in two steps, a count for each (length, bucket) and a window
inside it, so a length that a third of all pieces share is spread over all
buckets. Tokens are computed once: pieces are written to the shared folder.

Defined results: a null text is an empty one and gives a single piece with the
end id; a null doc_id is kept; repeated rows are packed as often as they
occur; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrobora.llm.arrowtext import blocks, buffers, gives_back
from corrobora.llm.durable import materialize

#: So many pieces are packed by branch and bound, in at most so many steps of enumeration a search.
FEW, STEPS = 100, 100_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _encode_pieces(vocabulary: str, end_id: int, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corrobora.llm.bpe import ENCODED_BYTES, encoder

        own = encoder(vocabulary)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False) if not batch.column("doc_id").null_count else None
            names = batch.column("doc_id")
            for i, j in blocks(offsets, ENCODED_BYTES):
                flat, rows = own.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                row, piece, start, length, crc = [], [], [], [], []
                end = np.asarray([end_id], "<u4").tobytes()
                for k in range(j - i):
                    raw = flat[rows[k] : rows[k + 1]].astype("<u4").tobytes() + end
                    n = len(raw) // 4
                    cut = n % capacity or capacity
                    edges = [0, *range(cut, n + 1, capacity)]
                    for p in range(len(edges) - 1):
                        row.append(i + k)
                        piece.append(p)
                        start.append(edges[p])
                        length.append(edges[p + 1] - edges[p])
                        crc.append(zlib.crc32(raw[4 * edges[p] : 4 * edges[p + 1]]))
                doc = pa.array(ids[row]) if ids is not None else names.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [doc.cast(pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def token_pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Pieces of each document's ids and the end id; only a longer document is cut, its first piece then takes the remainder."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode_pieces(vocabulary, end_id, capacity), PIECES)


Filling = tuple[tuple[int, int], ...]
Plan = list[tuple[int, Filling]]


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit decreasing over a histogram: (repetitions, ((length, times), ...))."""
    done: Plan = []
    open_: dict[int, list[list]] = {}  # room -> groups of [bins, filling]
    for size in sorted((x for x in counts if counts[x] > 0), reverse=True):
        left = counts[size]
        for room in sorted(r for r in open_ if r >= size):
            groups = open_[room]
            times = room // size
            while left and groups:
                bins, filling = groups.pop()
                full = min(bins, left // times)
                if full:
                    open_.setdefault(room - times * size, []).append([full, (*filling, (size, times))])
                    left -= full * times
                if full < bins and left:
                    open_.setdefault(room - left * size, []).append([1, (*filling, (size, left))])
                    left, full = 0, full + 1
                if full < bins:
                    groups.append([bins - full, filling])
                if not left:
                    break
            if not groups:
                open_.pop(room, None)
            if not left:
                break
        times = capacity // size
        if full := left // times:
            open_.setdefault(capacity - times * size, []).append([full, ((size, times),)])
        if rest := left % times:
            open_.setdefault(capacity - rest * size, []).append([1, ((size, rest),)])
    for groups in open_.values():
        done += [(bins, filling) for bins, filling in groups]
    return done


def fillings(counts: np.ndarray, room: int, most: int, nodes: int) -> list[Filling]:
    """Some full fillings of ``room`` from the lengths left, most full first, for greedy descents.

    A single length, else two, that fit exactly are taken at once; else at
    most ``nodes`` steps look for fillings fuller than the best-fit one, which
    is always among those found.
    """
    first = _greedy(counts, room)
    found: dict[Filling, int] = {first: room - sum(a * b for a, b in first)}
    if not found[first] or room <= 0:
        return [first]
    if counts[room]:
        return [((room, 1),)]
    sizes = np.flatnonzero(counts[: room + 1])
    # two lengths that fill the room exactly
    for a in sizes[::-1]:
        b = room - int(a)
        if b > a:
            break
        if b > 0 and counts[b] and (a != b or counts[b] > 1):
            return [((int(a), 2),) if a == b else ((int(a), 1), (b, 1))]
    best, budget = found[first], nodes

    def search(room_left: int, cap: int, have: list[int]) -> None:
        nonlocal best, budget
        options = sizes[sizes <= min(room_left, cap)][::-1]
        for s in options.tolist():
            if budget <= 0 or best == 0:
                return
            budget -= 1
            if have.count(s) >= counts[s]:
                continue
            rest = room_left - s
            tail = np.searchsorted(sizes, min(rest, s), "right") - 1
            if tail < 0 or rest == 0:
                if rest <= best:
                    best = rest
                    items = [*have, s]
                    found[tuple((x, items.count(x)) for x in sorted(set(items), reverse=True))] = rest
            else:
                search(rest, s, [*have, s])

    search(room, room, [])
    return sorted(found, key=lambda f: (found[f], len(f)))[:most]


def _greedy(counts: np.ndarray, room: int) -> Filling:
    out, top = [], room
    while room > 0:
        below = np.flatnonzero(counts[: min(top, room) + 1])
        if not len(below):
            break
        size = int(below[-1])
        times = min(int(counts[size]), room // size)
        out.append((size, times))
        room -= times * size
        top = size - 1
    return tuple(out)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer bins: the tokens' bound, the bound by pieces of which k at most share a bin, and Martello and Toth's L2."""
    sizes = np.array(sorted((k for k, v in counts.items() if v > 0), reverse=True), np.int64)
    if not len(sizes):
        return 0
    n = np.array([counts[s] for s in sizes.tolist()], np.int64)
    pieces, tokens = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * sizes)])
    best = -(-int(tokens[-1]) // capacity)

    def first(limit: np.ndarray) -> np.ndarray:
        """How many lengths exceed each limit."""
        return np.searchsorted(-sizes, -limit, "left")

    k = np.arange(1, capacity // int(sizes[-1]) + 1)
    best = max(best, int((-(-pieces[first(capacity // (k + 1))] // k)).max()))
    small = np.unique(np.append(sizes[2 * sizes <= capacity], 0))
    one, half, last = first(capacity - small), first(np.full(len(small), capacity // 2)), first(small - 1)
    two_pieces, two_tokens = pieces[half] - pieces[one], tokens[half] - tokens[one]
    spare = two_pieces * capacity - two_tokens
    more = np.maximum(0, -(-(tokens[last] - tokens[half] - spare) // capacity))
    return max(best, int((pieces[half] + more).max()))


def completions(left: list[list[int]], room: int, steps: list[int]) -> list[Filling]:
    """All undominated fillings of ``room`` from [length, count] pairs (descending), most full first.

    A single length that fits exactly dominates all. A filling is dropped when
    a length left could be added to it, or put in place of one or more smaller
    pieces of its (Martello and Toth's criterion for a single piece). ``steps[0]``
    is counted down; below 0 the enumeration was cut short.
    """
    have = [(s, n) for s, n in left if n and s <= room]
    if have and have[0][0] == room:
        return [((room, 1),)]
    found: list[tuple[int, Filling]] = []

    def dominated(times: list[int], rest: int) -> bool:
        sums = 1  # bit t: pieces of the filling, smaller than the one in hand, add up to t
        for (s, n), k in zip(reversed(have), reversed(times), strict=True):
            if k < n:
                low = max(0, s - rest)
                if sums >> low & ((1 << (s - low + 1)) - 1):
                    return True
            for _ in range(k):
                sums |= sums << s
        return False

    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, room, ())]
    while stack:
        steps[0] -= 1
        if steps[0] < 0:
            break
        i, rest, times = stack.pop()
        while i < len(have) and have[i][0] > rest:
            times, i = (*times, 0), i + 1
        if i == len(have):
            if not dominated(list(times), rest):
                found.append((rest, tuple((s, k) for (s, _), k in zip(have, times, strict=True) if k)))
            continue
        size, n = have[i]
        stack += [(i + 1, rest - k * size, (*times, k)) for k in range(min(n, rest // size) + 1)]
    return [f for _, f in sorted(found, key=lambda x: (x[0], sum(k for _, k in x[1])))]


def branch_and_bound(counts: dict[int, int], capacity: int, below: int, steps: int = STEPS) -> Plan | None:
    """The fewest bins for few pieces, if fewer than ``below``; None when there are none, or none found in ``steps``.

    Depth first with a stack: each level closes the bin of the largest piece left
    with one of its undominated fillings; a branch ends where its bins and the
    lower bound of the rest reach the best packing known.
    """
    sizes = sorted((k for k, v in counts.items() if v), reverse=True)
    least, best, plan = lower_bound(counts, capacity), below, None
    budget = [steps]
    seen: dict[tuple[int, ...], int] = {}

    def options(left: tuple[int, ...]) -> Iterator[Filling]:
        top = next(i for i, n in enumerate(left) if n)
        share = [max(1, min(budget[0], steps // 20))]  # no single room takes all steps
        given = share[0]
        found = completions([[s, n - (i == top)] for i, (s, n) in enumerate(zip(sizes, left, strict=True))], capacity - sizes[top], share)
        budget[0] -= given - max(0, share[0])
        for option in found or [()]:
            need = dict(option)
            need[sizes[top]] = need.get(sizes[top], 0) + 1
            yield tuple(need.items())

    start = tuple(counts[s] for s in sizes)
    bins: list[Filling] = []
    stack = [(start, options(start))] if sizes else []
    while stack and best > least and budget[0] > 0:
        left, rest = stack[-1]
        filling = next(rest, None)
        if filling is None:
            stack.pop()
            if bins:
                bins.pop()
            continue
        need = dict(filling)
        after = tuple(n - need.get(s, 0) for s, n in zip(sizes, left, strict=True))
        used = len(bins) + 1
        if not any(after):
            if used < best:
                best, plan = used, [(1, f) for f in (*bins, filling)]
            continue
        if seen.get(after, below) <= used or used + lower_bound(dict(zip(sizes, after, strict=True)), capacity) >= best:
            continue
        seen[after] = used
        bins.append(filling)
        stack.append((after, options(after)))
    return plan


def complete_bins(counts: dict[int, int], capacity: int, width: int = 3, tries: int = 12, nodes: int = 300) -> Plan:
    """Packs a histogram of lengths.

    At most ``FEW`` pieces are searched as a whole. Of more, ``tries`` descents
    close bins greedily until ``FEW`` are left, which are searched; each tries
    ``width`` fillings of a bin, found in ``nodes`` steps. All ends at the lower bound.
    """
    counts = {k: v for k, v in counts.items() if v > 0}
    if not counts:
        return []
    least = lower_bound(counts, capacity)
    incumbent = best_fit(counts, capacity)
    best = sum(n for n, _ in incumbent)
    if best > least and sum(counts.values()) <= FEW:
        return branch_and_bound(counts, capacity, best) or incumbent
    for discrepancy in range(tries * (width - 1) + 1):
        if best <= least:
            break
        plan = _descend(dict(counts), capacity, best, width, -(-discrepancy // (width - 1)), 1 + (discrepancy - 1) % (width - 1), nodes)
        if plan is not None:
            incumbent, best = plan, sum(n for n, _ in plan)
    return incumbent


def _descend(counts: dict[int, int], capacity: int, best: int, width: int, departure: int, other: int, nodes: int) -> Plan | None:
    """One descent that takes the ``other``-th filling instead of the fullest at one choice; few pieces left are searched. None when cut off by the lower bound."""
    left = np.zeros(capacity + 1, np.int64)
    for k, v in counts.items():
        left[k] = v
    tokens = int((left * np.arange(capacity + 1)).sum())
    plan, used, choices = [], 0, 0
    while tokens:
        if left.sum() <= FEW:
            rest = branch_and_bound({int(k): int(left[k]) for k in np.flatnonzero(left)}, capacity, best - used)
            return rest and plan + rest
        top = int(np.flatnonzero(left)[-1])
        left[top] -= 1
        options = fillings(left, capacity - top, width, nodes) if top < capacity else [()]
        left[top] += 1
        pick = 0
        if len(options) > 1:
            choices += 1
            pick = min(other, len(options) - 1) if choices == departure else 0
        need = dict(options[pick])
        need[top] = need.get(top, 0) + 1
        times = min(int(left[s]) // n for s, n in need.items())
        for s, n in need.items():
            left[s] -= n * times
        tokens -= times * sum(s * n for s, n in need.items())
        used += times
        plan.append((times, tuple(need.items())))
        if used + -(-tokens // capacity) >= best:
            return None
    return plan


def placements(plan: Plan) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, times a bin, first sequence, offset) of each run of equal fillings."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for bins, filling in plan:
        offset = 0
        for size, times in filling:
            begin = taken.get(size, 0)
            taken[size] = begin + bins * times
            out.append((size, begin, taken[size], times, sequence, offset))
            offset += size * times
        sequence += bins
    return out


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, capacity: int = 2048, bucket_rows: int = 50_000) -> DataFrame:
    """Packs documents into sequences of at most ``capacity`` tokens: one row per piece with its sequence and place."""
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, vocabulary, end_id, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = placements(complete_bins(counts, capacity))
    table = F.broadcast(spark.createDataFrame(runs, "length long, begin long, end long, times long, first long, base long"))
    buckets = max(16, sum(counts.values()) // bucket_rows)
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    sums = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("length", "bucket").orderBy("row")
    ranked = keyed.withColumn("inside", F.row_number().over(inside) - 1).join(sums, ["length", "bucket"])
    rank = (F.col("earlier") + F.col("inside")).alias("rank")
    return (
        ranked.select(*pieces.columns, rank)
        .join(table.withColumnRenamed("length", "size"), (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("begin")) & (F.col("rank") < F.col("end")))
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("first") + F.expr("(rank - begin) div times")).alias("sequence_id"),
            (F.col("base") + ((F.col("rank") - F.col("begin")) % F.col("times")) * F.col("length")).alias("offset"),
            F.lit(lower_bound(counts, capacity)).cast("long").alias("least_sequences"),
        )
    )
