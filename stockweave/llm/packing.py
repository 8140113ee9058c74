"""Best-fit packing of token sequences by bin completion.

Documents become pieces of at most ``size`` tokens. How pieces can be packed depends only on how many there are of each length, so the
search runs on the histogram of lengths, which has at most ``size`` rows however large the corpus is. It yields a list of patterns, each
a multiset of lengths and a number of sequences filled that way, at most a few for each length. Every piece finds its own place: its rank among the
pieces of its length (a prefix count over tasks plus its number inside its task) falls in the range of one pattern. No piece meets another in a
task, and a length that most pieces share is spread like any other.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from stockweave.functions.runtime import materialize
from stockweave.llm import tokens

SIZE, END = 1024, 2
PIECES = "piece int, start long, length long, ids_crc32 long, task int, rank long"


# --- the search, on counts of lengths -------------------------------------------------------------------------------

def best_fit(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: (pattern, sequences). Bins with equal room and content move together."""
    bins: dict[int, list[list]] = {}  # room -> [pattern, number]
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], number: int) -> None:
        if room not in bins:
            bins[room] = []
            insort(rooms, room)
        bins[room].append([pattern, number])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_right(rooms, length - 1)
            if at < len(rooms):
                room = rooms[at]
                pattern, number = bins[room].pop()
                if not bins[room]:
                    del bins[room]
                    rooms.pop(at)
            else:
                room, pattern, number = size, (), -(-left // (size // length))
            each = room // length  # best fit goes on filling a bin as long as it takes one more
            full = min(number, left // each)
            if full:
                put(room - each * length, pattern + (length,) * each, full)
            rest = left - full * each
            if full < number and rest:
                put(room - rest * length, pattern + (length,) * rest, 1)
                full, rest = full + 1, 0
            if full < number and pattern:
                put(room, pattern, number - full)
            left = rest
    return [(pattern, number) for group in bins.values() for pattern, number in group]


def fillings(counts: dict[int, int], room: int, most_waste: int):
    """Undominated ways to fill ``room`` from ``counts`` that waste at most ``most_waste``, least waste first, then with the larger pieces first. None stands
    for a dominated one that was passed over.

    A filling of one piece of exactly the room dominates all others. Any other is dominated if a piece left fits beside it, or fits in the place of a
    smaller one or of two that are together no larger. The sums that can be reached are known for each length, so the walk has no dead ends.
    """
    lengths = sorted(x for x, n in counts.items() if n and x <= room)
    if lengths and lengths[-1] == room:
        yield (room,)
        return
    reach, mask = [1], (1 << room + 1) - 1  # sums of the lengths before each, as bits
    for x in lengths:
        sums, n, k = reach[-1], min(counts[x], room // x), 1
        while n > 0:
            sums |= sums << x * min(k, n) & mask
            n, k = n - k, 2 * k
        reach.append(sums)

    def walk(i: int, left: int, chosen: tuple[int, ...]):
        """Sets of exactly ``left`` from the first i lengths."""
        if not left:
            yield chosen
        while left and i:
            i -= 1
            x = lengths[i]
            for n in range(min(counts[x], left // x), 0, -1):
                if reach[i] >> left - n * x & 1:
                    yield from walk(i, left - n * x, chosen + (x,) * n)
            if not reach[i] >> left & 1:
                return

    def dominated(chosen: tuple[int, ...], waste: int) -> bool:
        spare = [x for x in lengths if counts[x] > chosen.count(x)]
        if spare and spare[0] <= waste:
            return True
        fits = lambda low, high: (at := bisect_right(spare, high)) and spare[at - 1] >= low
        if waste and any(fits(x + 1, x + waste) for x in set(chosen)):
            return True
        return any(fits(a + b, a + b + waste) for a, b in set(combinations(chosen, 2)))

    for waste in range(min(room, most_waste) + 1):
        if reach[-1] >> room - waste & 1:
            for chosen in walk(len(lengths), room - waste, ()):
                yield None if dominated(chosen, waste) else chosen


def complete(counts: dict[int, int], size: int, nodes: int = 4_000) -> list[tuple[tuple[int, ...], int]]:
    """Bin completion: patterns (lengths, sequences) that hold all pieces of ``counts`` in as few sequences as the search finds.

    Each step takes the largest piece left and one of the undominated fillings around it, as many times as the counts allow or, as further branches, fewer
    times; then only fillings behind it in their order go on with that piece. The first incumbent is
    best-fit decreasing. A branch is left when the waste it has made leaves no room to beat the
    incumbent: its sequences, and those that its pieces left need by their tokens or by how many are over half a sequence. The search ends when it meets the
    lower bound, has tried everything, or has looked at ``nodes`` nodes and dominated fillings; then the best packing so far stands.
    """
    counts = {k: v for k, v in counts.items() if v}
    total = sum(k * v for k, v in counts.items())
    incumbent = best_fit(counts, size)
    best = sum(n for _, n in incumbent)
    least = bound(counts, size)
    seen = 0

    def options(left, path, made, tokens_left, last):
        """Nodes below a node; None for a dominated filling."""
        first = max(left)
        without = dict(left)
        without[first] -= 1
        for filling in fillings(without, size - first, (best - 1 - made) * size - tokens_left):
            if filling is None:
                yield None
                continue
            pattern = (first, *filling)
            order = (first, size - sum(pattern), [-x for x in filling])
            if last and last[0] == first and order[1:] <= last[1:]:
                yield None
                continue
            need: dict[int, int] = {}
            for x in pattern:
                need[x] = need.get(x, 0) + 1
            for times in range(min(left[x] // n for x, n in need.items()), 0, -1):
                after = {x: n - need.get(x, 0) * times for x, n in left.items()}
                yield {x: n for x, n in after.items() if n}, (path, (pattern, times)), made + times, tokens_left - times * sum(pattern), order

    # depth first: the nodes below each node of the path are made as they are needed
    stack = [iter([(counts, None, 0, total, None)])]  # counts left, patterns so far as a linked list, sequences so far, tokens left, last filling
    while stack and best > least and seen < nodes:
        node = next(stack[-1], False)
        if node is False:
            stack.pop()
            continue
        seen += 1
        if node is None:
            continue
        left, path, made, tokens_left, _ = node
        if not left:
            if made < best:
                best, incumbent = made, []
                while path:
                    path, step = path
                    incumbent.append(step)
            continue
        if made + max(-(-tokens_left // size), sum(n for x, n in left.items() if 2 * x > size)) < best:
            stack.append(options(*node))
    return incumbent


def bound(counts: dict[int, int], size: int) -> int:
    """Sequences that are needed at least: by tokens, and by pieces over half a sequence with the room that small pieces can't use."""
    total = sum(k * v for k, v in counts.items())
    best = -(-total // size)
    half = sum(v for k, v in counts.items() if 2 * k > size)
    for small in sorted(k for k in counts if 2 * k <= size)[:64]:
        alone = sum(v for k, v in counts.items() if k > size - small)  # nothing as long as ``small`` fits beside these
        pairs = [(k, v) for k, v in counts.items() if size // 2 < k <= size - small]
        rest = sum(k * v for k, v in counts.items() if small <= k and 2 * k <= size)
        room = sum(v * (size - k) for k, v in pairs)
        best = max(best, alone + sum(v for _, v in pairs) + max(0, -(-(rest - room) // size)))
    return max(best, half)


# --- the corpus ------------------------------------------------------------------------------------------------------

def _pieces(batches, vocabulary: str, size: int, end: int):
    """Pieces of each document with its number among the task's pieces of that length."""
    from pyspark import TaskContext

    task, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
    coder = tokens.encoder(vocabulary)
    for batch in batches:
        for lo, hi, texts in tokens.runs(batch.column("text")):
            flat, counts = coder.encode(texts)
            ids, ends = tokens.with_end(flat, counts, end)
            own = counts + 1
            parts = -(-own // size)
            doc = np.repeat(np.arange(len(own)), parts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
            first = own - (parts - 1) * size
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * size)
            length = np.where(piece == 0, first[doc], size)
            at = (ends - own)[doc] + start
            crc = [tokens.crc32(ids[a:a + n]) for a, n in zip(at.tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            new = np.empty(len(order), np.int64)
            new[order] = np.arange(len(order)) - np.searchsorted(ranked, ranked, side="left") + seen[ranked]
            seen += np.bincount(length, minlength=size + 1)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(lo, hi - lo).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task), pa.int32()), pa.array(new, pa.int64())],
                ["doc_id", *[f.split()[0] for f in PIECES.split(", ")]])


def pieces(docs: DataFrame, size: int = SIZE, end: int = END, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """Pieces of each row of ``docs`` (doc_id, text), written once: only documents longer than ``size`` are cut, the first piece may be shorter."""
    kind = dict(docs.dtypes)["doc_id"]
    return materialize(docs.select("doc_id", "text").mapInArrow(lambda b: _pieces(b, vocabulary, size, end), f"doc_id {kind}, {PIECES}"), "pieces")


def layout(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Ranges of ranks for each length: arrays (length, first rank, per sequence, first sequence, offset), sorted by length and rank.

    One entry for each length of each pattern; the offset is where the pattern's first piece of that length begins.
    """
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, number in patterns:
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            each = pattern.count(length)
            rows.append((length, used.get(length, 0), each, sequence, offset))
            used[length] = used.get(length, 0) + each * number
            offset += each * length
        sequence += number
    return tuple(np.array(c, np.int64) for c in zip(*sorted(rows))) if rows else (np.zeros(0, np.int64),) * 5


def _place(batches, ranges: tuple[np.ndarray, ...]):
    lengths, firsts, each, sequences, offsets = ranges
    starts = np.searchsorted(lengths, np.arange(int(lengths[-1]) + 2 if len(lengths) else 1))
    for batch in batches:
        length = batch.column("length").to_numpy()
        rank = batch.column("_rank").to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for x in np.unique(length):  # as many as there are lengths
            rows = np.nonzero(length == x)[0]
            lo, hi = starts[x], starts[x + 1]
            at = lo + np.searchsorted(firsts[lo:hi], rank[rows], side="right") - 1
            inside = rank[rows] - firsts[at]
            sequence[rows] = sequences[at] + inside // each[at]
            offset[rows] = offsets[at] + inside % each[at] * x
        names = [n for n in batch.schema.names if n != "_rank"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])


def pack(docs: DataFrame, size: int = SIZE, end: int = END, vocabulary: str = tokens.VOCABULARY, nodes: int = 4_000) -> DataFrame:
    """Place of every piece of ``docs`` (doc_id, text; other columns are ignored): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone. Repeated rows and ids are documents of their own. A text of any length is cut into as many pieces
    as it needs. An empty table gives no rows. The histogram (``size`` rows) comes to the driver, and the patterns (a few for each length) go
    to the tasks; both are bounded by ``size``, whatever the input.
    """
    cut = pieces(docs, size, end, vocabulary)
    cells = materialize(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "cells")
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranges = layout(complete(counts, size, nodes))
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    base = cells.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    ranked = cut.join(base, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("_before")).alias("_rank"))
    kind = dict(docs.dtypes)["doc_id"]
    return ranked.mapInArrow(lambda b: _place(b, ranges), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
