"""Near-duplicates by SetSketch: truncated minima in exponential spacing, banded registers, joint likelihood, exact check.

A document's set of shingles gives every register an exponential variable of rate ``rate`` for each of its members; the register keeps how far their minimum lies on a
scale of powers of ``base``, cut off at both ends of the scale. A register of a union is the larger of both (:func:`merge`), so sketches of parts of a text or of a
corpus add up. Two registers are equal with a probability that grows with the Jaccard similarity J and, for a base near 1, is about J.

* Bands of ``rows`` registers are bucket keys. A pair of J = 0.85 shares none of 32 bands of 4 with a probability of 6e-11, of J = 0.8 of 5e-8; no pair is lost
  otherwise. Equal sets are one row before anything is joined.
* Members of a bucket first meet its smallest one, one pair for each member, and what the check confirms is tied together. The check also gives how the member differs
  from the smallest one, its reference: two members of one reference c have |c| - |c \\ x| - |c \\ y| + (differences that both have) shingles in common, so all their pairs are decided
  by the differences alone, in cells, and of the links of a cell a spanning forest leaves the task. However many texts are alike just below the wanted similarity, none of their pairs is written.
* Then members of different components and references are compared by their whole sketches, in cells of two chunks of a bucket: sizes that can't be similar and pairs whose registers are too unlikely under the wanted
  similarity go. The likelihood takes both exact sizes and the three counts of larger, smaller and equal registers jointly; a pair is left out where the best J is e^SLACK
  times as likely as the wanted one, which happens to a similar pair with a probability of about 1e-9. Each member first meets the one partner
  that differs from it in the fewest bits; turns go on while a tenth of these pairs are links, and the last turn takes every pair that is left.
* Every pair is confirmed on the full sets of shingles of both texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stockweave.functions.runtime import materialize
from stockweave.llm import simhash
from stockweave.llm.common import released
from stockweave.llm.components import components

CHUNK = 2048  # members of a chunk of a bucket
DIFFERENCES = 1 << 20  # of the members of a chunk of a reference
SLACK = 20.0
WORDS, SEED = 5, 42
BLOCK = 1 << 20  # bytes of words that are hashed at a time


@dataclass(frozen=True)
class Sketch:
    """``bands`` * ``rows`` registers of two bytes; with base 1.001 and rate 20 the scale holds sets of 1 to 1e18 members."""

    bands: int = 32
    rows: int = 4
    base: float = 1.001
    rate: float = 20.0

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that mixes them."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = spread(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # a number for each byte; A to Z have those of a to z
_LETTER[ord("A"):ord("Z") + 1] = _LETTER[ord("a"):ord("z") + 1]
_ODD = np.uint64(0xD1342543DE82EF95)


def word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of bytes and where it starts: the sum of its letters' numbers times powers of an odd number, by blocks of words."""
    word = ~_SPACE[text]
    starts = np.flatnonzero(word & np.append(True, ~word[:-1]))
    lengths = np.flatnonzero(word & np.append(~word[1:], True)) + 1 - starts
    letters, ends = text[word], np.cumsum(lengths)
    powers = np.cumprod(np.full(int(lengths.max(initial=1)), _ODD, np.uint64))
    out, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):
        begin = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, begin + BLOCK, side="right")))
        own, cuts = lengths[first:last], ends[first:last] - lengths[first:last] - begin
        at = np.arange(int(ends[last - 1]) - begin) - np.repeat(cuts, own)
        out[first:last] = np.add.reduceat(_LETTER[letters[begin:ends[last - 1]]] * powers[at], cuts)
        first = last
    return out, starts


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """For each text its different five-word shingles, as ascending hashes. A shorter text is one shingle, one without words has none."""
    flat, starts = word_hashes(np.frombuffer(b" ".join(t or b"" for t in texts), np.uint8))
    ends = np.searchsorted(starts, np.cumsum([len(t or b"") + 1 for t in texts]))
    shingles = np.zeros(max(0, len(flat) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        shingles = spread(shingles * np.uint64(0x9E3779B97F4A7C15) + flat[k:k + len(shingles)])
    out, begin = [], 0
    for end in ends.tolist():
        n = end - begin
        if n >= WORDS:
            own = np.sort(shingles[begin:end - WORDS + 1])
            own = own[np.append(True, own[1:] != own[:-1])]
        elif n:
            own = np.array([n], np.uint64)  # the number of words, then all of them
            for h in flat[begin:end]:
                own = spread(own * np.uint64(0x9E3779B97F4A7C15) + h)
        else:
            own = np.zeros(0, np.uint64)
        out.append(own)
        begin = end
    return out


def set_key(each: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(each.tobytes(), SEED)).astype(np.int64))


def runs(texts: list, most: int = BLOCK):
    """Runs of a list of texts with about ``most`` bytes each, so that one turn's arrays stay small."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t or b"") > most:
            yield start, i
            start, size = i, 0
        size += len(t or b"")
    if start < len(texts):
        yield start, len(texts)


def registers(sets: list[np.ndarray], s: Sketch) -> np.ndarray:
    """A row of registers for each set of hashes; the empty set has zeros.

    The minimum of -ln(1 - u) / rate over a set is that of its smallest u, so the smallest hash of each register is found first and put on the scale once."""
    sizes = np.array([len(x) for x in sets], np.int64)
    some = np.flatnonzero(sizes)
    out = np.zeros((len(sets), s.registers), np.uint16)
    if not len(some):
        return out
    low = np.empty((len(some), s.registers), np.uint64)
    flat = np.concatenate([sets[i] for i in some])
    ends = np.cumsum(sizes[some])
    step = 1 << 14  # members of one turn, so that they stay in the cache
    odd = spread(np.arange(1, s.registers + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    first = 0
    while first < len(some):
        begin = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, begin + step, side="right")))
        own = flat[begin:ends[last - 1]]
        cuts = np.concatenate([[0], ends[first:last - 1] - begin])
        for r, c in enumerate(odd):
            h = own * c
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            low[first:last, r] = np.minimum.reduceat(h, cuts)
        first = last
    u = (low.astype(np.float64) + 0.5) / 2.0 ** 64
    scale = np.floor(1 - np.log(-np.log1p(-np.minimum(u, 1 - 2.0 ** -53)) / s.rate) / np.log(s.base))
    out[some] = np.clip(scale, 0, 65535).astype(np.uint16)
    return out


def merge(sketches: list[bytes]) -> bytes:
    """The sketch of the union of the sets of ``sketches``."""
    return np.maximum.reduce([np.frombuffer(x, "<u2") for x in sketches]).tobytes()


def _larger(x: np.ndarray, base: float) -> np.ndarray:
    """Probability that a register of one set is the larger one, for the share ``x`` of members that only it has."""
    return -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base)


def likelihood(j, nu, nv, more, fewer, same, base: float) -> np.ndarray:
    """Log likelihood of similarity ``j`` for sets of ``nu`` and ``nv`` members and the counts of larger, smaller and equal registers."""
    total = nu + nv
    u, v = nu / total, nv / total
    p, q = _larger(u - v * j, base), _larger(v - u * j, base)
    tiny = 1e-12
    return more * np.log(np.maximum(p, tiny)) + fewer * np.log(np.maximum(q, tiny)) + same * np.log(np.maximum(1 - p - q, tiny))


def best_similarity(nu, nv, more, fewer, same, base: float, turns: int = 30) -> np.ndarray:
    """The similarity of the greatest likelihood, by golden sections: the likelihood has one peak."""
    low, high = np.zeros(np.shape(nu)), np.minimum(nu, nv) / np.maximum(nu, nv)
    g = (5 ** 0.5 - 1) / 2
    for _ in range(turns):
        a, b = high - g * (high - low), low + g * (high - low)
        left = likelihood(a, nu, nv, more, fewer, same, base) > likelihood(b, nu, nv, more, fewer, same, base)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2


def can_be(regs_a: np.ndarray, regs_b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int, base: float) -> np.ndarray:
    """For each pair of rows whether a similarity of ``percent`` in 100 can't be ruled out."""
    more = (regs_a > regs_b).sum(axis=1)
    same = (regs_a == regs_b).sum(axis=1)
    fewer = regs_a.shape[1] - more - same
    na, nb = na.astype(float), nb.astype(float)
    want = np.minimum(percent / 100, np.minimum(na, nb) / np.maximum(na, nb))
    at = likelihood(want, na, nb, more, fewer, same, base)
    best = best_similarity(na, nb, more, fewer, same, base)
    return (best >= want) | (likelihood(best, na, nb, more, fewer, same, base) - at <= SLACK)


def sketches(docs: DataFrame, s: Sketch = Sketch(), prints: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fp (key of its set), n (size of its set), regs (registers, two bytes each), text_key, print (with ``prints`` the
    SimHash of its set, else null)."""
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in runs(texts):
                each = shingle_sets(texts[lo:hi])
                regs = registers(each, s).astype("<u2")
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("text_key"), pa.array([set_key(x) for x in each], pa.int64()), pa.array([len(x) for x in each], pa.int64()),
                    pa.array([r.tobytes() for r in regs], pa.binary()), pa.array([simhash.print_of_set(x) if prints else None for x in each], pa.int64())],
                    ["doc_id", "text_key", "fp", "n", "regs", "print"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(lambda b: released(run(b)), f"doc_id {dict(docs.dtypes)['doc_id']}, text_key bigint, fp bigint, n bigint, regs binary, print bigint")


def band_keys(s: Sketch, regs: str = "regs") -> Column:
    """One key for each band of registers."""
    wide = 2 * s.rows
    return F.array(*[F.xxhash64(F.lit(i), F.substring(regs, 1 + wide * i, wide)) for i in range(s.bands)])


def _confirmed(batches, percent: int, differences: bool = False):
    """The pairs whose full sets are similar; with ``differences`` all pairs, and how b differs from a where they have half of their shingles in common. The pairs of a
    batch are mostly sorted by one side, so the last few sets are kept."""
    kept: dict[int, np.ndarray] = {}

    def of(key: int, text: bytes) -> np.ndarray:
        if key not in kept:
            if len(kept) >= 64:
                kept.pop(next(iter(kept)))
            kept[key] = shingle_sets([text])[0]
        return kept[key]

    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part, ok, told = batch.slice(lo, 256), [], []
            for a, b, x, y in zip(*(part.column(c).to_pylist() for c in ("a", "b", "x", "y"))):
                x, y = of(a, x), of(b, y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
                if differences:
                    half = 2 * both >= len(x) + len(y) - both
                    told.append((len(y), len(x), len(x) - both, np.setxor1d(x, y, assume_unique=True).view(np.int64) if half else None))
            part = part.select(["a", "b"])
            if not differences:
                yield part.filter(pa.array(ok, pa.bool_()))
                continue
            n, size, lost, diff = zip(*told)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ok, pa.bool_()), *(pa.array(c, pa.int64()) for c in (n, size, lost)), pa.array(diff, pa.list_(pa.int64()))],
                                             ["a", "b", "linked", "n", "size", "lost", "diff"])


def confirm(pairs: DataFrame, texts: DataFrame, percent: int, differences: bool = False) -> DataFrame:
    """The ``pairs`` (a, b) whose ``texts`` (fp, text) have a similarity of ``percent`` in 100 or more, written; with ``differences`` all pairs with linked, n (size of b), size
    (that of a), lost (shingles of a that b lacks) and diff (the shingles that one of both has)."""
    side = lambda k, t: texts.select(F.col("fp").alias(k), F.col("text").alias(t))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
    more = ", linked boolean, n bigint, size bigint, lost bigint, diff array<bigint>" if differences else ""
    return materialize(both.mapInArrow(lambda rows: released(_confirmed(rows, percent, differences)), "a bigint, b bigint" + more), "similar")


def _of_reference(batches, percent: int, columns: int = 2048):
    """Spanning forests of the links between members of a reference, cell by cell: what two members have in common follows from their differences."""
    for batch in batches:
        left_ends, right_ends = [], []
        for row in range(batch.num_rows):
            size, ci, cj = (batch.column(c)[row].as_py() for c in ("size", "ci", "cj"))
            ms = batch.column("members")[row].values
            fp, n, lost, root, chunk = (np.asarray(ms.field(c)).astype(np.int64) for c in ("fp", "n", "lost", "root", "chunk"))
            diff = ms.field("diff")
            counts = np.asarray(diff.value_lengths()).astype(np.int64)
            tokens, held = np.asarray(diff.flatten()), np.repeat(np.arange(len(fp)), counts)
            left = np.flatnonzero(chunk == ci)
            right = left if ci == cj else np.flatnonzero(chunk == cj)
            at = np.full(len(fp), -1)
            at[left] = np.arange(len(left))
            other = at if ci == cj else np.full(len(fp), -1)
            other[right] = np.arange(len(right))
            _, token, times = np.unique(tokens, return_inverse=True, return_counts=True)
            shared = np.flatnonzero(times > 1)
            place = np.full(len(times), -1)
            place[shared] = np.arange(len(shared))
            token, held = place[token], held[place[token] >= 0] if len(token) else held
            token = token[token >= 0]
            order = np.argsort(token, kind="stable")
            token, held = token[order], held[order]
            common = np.zeros((len(left), len(right)), np.float32)
            for lo in range(0, len(shared), columns):  # counts of shared differences as products of matrices
                some = slice(*np.searchsorted(token, [lo, lo + columns]))
                sides = []
                for where, m in ((at, len(left)), (other, len(right))):
                    bits = np.zeros((m, columns), np.float32)
                    mine = where[held[some]] >= 0
                    bits[where[held[some]][mine], token[some][mine] - lo] = 1
                    sides.append(bits)
                common += sides[0] @ sides[1].T
            both = common.astype(np.int64) + (size - lost[left][:, None] - lost[right][None, :])
            linked = (100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)) & (root[left][:, None] != root[right][None, :])
            i, j = np.nonzero(linked)
            label = simhash.smallest(len(fp), left[i], right[j])
            moved = np.flatnonzero(label != np.arange(len(fp)))
            left_ends.append(fp[label[moved]])
            right_ends.append(fp[moved])
        if left_ends:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left_ends), pa.int64()), pa.array(np.concatenate(right_ends), pa.int64())], ["a", "b"])


def of_reference(compared: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that tie all similar sets of one reference, from the differences of ``compared`` (see :func:`confirm`); those of one component of ``roots`` are tied already.

    As in :func:`across` a reference's largest component is no partner of itself; chunks hold at most about ``DIFFERENCES`` differences."""
    rows = compared.filter("diff IS NOT NULL").join(roots, F.col("b") == F.col("node"), "left")
    rows = materialize(rows.select(F.col("a").alias("ref"), F.col("b").alias("fp"), "n", "size", "lost", "diff", F.coalesce("root", "b").alias("root")), "differences")
    sizes = rows.groupBy("ref", "root").agg(F.count("*").alias("m"), F.sum(F.size("diff")).alias("d")).groupBy("ref").agg(
        F.max(F.struct("m", "root", "d")).alias("top"), F.sum("m").alias("m"), F.sum("d").alias("d"))
    up = lambda m, d: F.greatest(F.ceil(m / CHUNK), F.ceil(d / DIFFERENCES)).cast("int")
    sizes = sizes.filter("m > top.m").select("ref", F.col("top.root").alias("_top"), up(F.col("m") - F.col("top.m"), F.col("d") - F.col("top.d")).alias("few"), up(F.col("top.m"), F.col("top.d")).alias("many"))
    cells = _meeting(rows.join(sizes, "ref"), F.col("root") == F.col("_top"))
    cells = cells.groupBy("ref", "size", "ci", "cj").agg(F.collect_list(F.struct("fp", "n", "lost", "root", "chunk", "diff")).alias("members"))
    cells = cells.filter(F.size(F.array_distinct("members.root")) > 1).drop("ref")
    return cells.mapInArrow(lambda b: released(_of_reference(b, percent)), "a bigint, b bigint")


def _meeting(rows: DataFrame, own: Column) -> DataFrame:
    """``rows`` once for each cell (ci, cj) that their chunk is part of: ``few`` chunks meet all others, the ``many`` of the largest class (``own``) only those."""
    code = F.xxhash64("fp")
    return (rows.withColumn("chunk", F.when(own, F.col("few") + F.pmod(code, F.col("many"))).otherwise(F.pmod(code, F.col("few"))).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(own, F.col("few") - 1).otherwise(F.col("few") + F.col("many") - 1))))
            .withColumns({"ci": F.least("chunk", "other"), "cj": F.greatest("chunk", "other")}))


def tail(n: int, p: float, slack: float = SLACK) -> int:
    """The largest count that ``n`` draws of probability ``p`` still reach with a probability of e^-slack or more (Chernoff's bound)."""
    for c in range(int(n * p) + 1, n + 1):
        x = min(c / n, 1 - 1e-12)
        if n * (x * np.log(x / p) + (1 - x) * np.log((1 - x) / (1 - p))) > slack:
            return c - 1
    return n


def in_first_band(bands: np.ndarray, band: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows (i, j) share no band before ``band``: a pair is looked at in the first bucket it shares only."""
    left = np.arange(len(i))
    for e in range(bands.shape[1]):
        left = left[(e >= band[left]) | (bands[i[left], e] != bands[j[left], e])]
    return left


def _pairs_inside(sizes: np.ndarray, begins: np.ndarray, cells: list[tuple[np.ndarray, np.ndarray]], block: int):
    """Places (i, j) of the pairs that cells compare, in blocks: of all members of small cells, and of ``cells``, (left, right) places of large ones."""
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at, ends = np.repeat(begins, sizes) + inside, np.cumsum(inside)
    for lo in range(0, int(ends[-1]) if len(ends) else 0, block):
        pair = np.arange(lo, min(lo + block, int(ends[-1])))
        row = np.searchsorted(ends, pair, side="right")
        yield at[row], at[row] - 1 - (pair - (ends[row] - inside[row]))
    for left, right in cells:
        step = max(1, block // len(right))
        for lo in range(0, len(left), step):
            i, j = np.repeat(left[lo:lo + step], len(right)), np.tile(right, len(left[lo:lo + step]))
            yield (i, j) if left is not right else (i[i > j], j[i > j])


def _across(batches, percent: int, s: Sketch, best: bool, block: int = 1 << 18, small: int = 64):
    """Pairs of different components inside cells that can be similar; with ``best`` one for each member and batch of cells, by the bits that differ.

    Of each register one bit is compared first, as two words for each pair; then whole registers, in the first band that both share; then the likelihood."""
    unlike = 1.1 * (1 - percent / 100)  # of registers, with some room for the spacing of the scale
    most_bits, most_unequal = tail(s.registers, unlike / 2), tail(s.registers, unlike)
    for batch in batches:
        lists = batch.column("members")
        ms, sizes = lists.flatten(), np.asarray(lists.value_lengths()).astype(np.int64)
        ids, n, root, chunk, ref = (np.asarray(ms.field(c)).astype(np.int64) for c in ("fp", "n", "root", "chunk", "ref"))
        regs = np.frombuffer(b"".join(ms.field("regs").to_pylist()), "<u2").reshape(len(ids), -1)
        bits = np.packbits(regs & 1 == 1, axis=1)
        bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)
        bands = np.zeros((len(ids), s.bands), np.uint64)
        for r in range(s.rows):  # of up to four registers: the registers themselves
            bands = spread(bands) if r >= 4 else bands
            bands = (bands << np.uint64(16)) ^ regs[:, r::s.rows].astype(np.uint64)
        begins, few = np.cumsum(sizes) - sizes, sizes <= small
        cell = np.repeat(np.arange(len(sizes)), sizes)
        ci, cj, band = (np.asarray(batch.column(c)).astype(np.int64) for c in ("ci", "cj", "band"))
        large = []
        for k in np.flatnonzero(~few).tolist():
            left = begins[k] + np.flatnonzero(chunk[begins[k]:begins[k] + sizes[k]] == ci[k])
            right = left if ci[k] == cj[k] else begins[k] + np.flatnonzero(chunk[begins[k]:begins[k] + sizes[k]] == cj[k])
            if len(left) and len(right):
                large.append((left, right))
        found = [(np.zeros(0, np.int64),) * 3]
        for i, j in _pairs_inside(sizes[few], begins[few], large, block):
            ok = (root[i] != root[j]) & (ref[i] != ref[j]) & ((ci[cell[i]] == cj[cell[i]]) | (chunk[i] != chunk[j])) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            i, j = i[ok], j[ok]
            apart = sum(np.bitwise_count(bits[i, w] ^ bits[j, w]).astype(np.int64) for w in range(bits.shape[1]))
            ok = np.flatnonzero(apart <= most_bits)
            if best:
                found.append(nearest(np.append(i[ok], j[ok]), np.append(j[ok], i[ok]), np.append(apart[ok], apart[ok]), ids))
                continue
            ok = ok[in_first_band(bands, band[cell[i[ok]]], i[ok], j[ok])]
            for lo in range(0, len(ok), block >> 4):
                part = ok[lo:lo + (block >> 4)]
                found.append(likely(i[part], j[part], apart[part], regs, n, percent, s, most_unequal))
        x, y, apart = (np.concatenate(c) for c in zip(*found))
        if best:
            x, y, apart = nearest(x, y, apart, ids)
            x, y, apart = likely(x, y, apart, regs, n, percent, s, most_unequal)
        yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y]), pa.array(apart)], ["a", "b", "apart"])


def nearest(x: np.ndarray, y: np.ndarray, apart: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place x the pair of fewest bits apart, then of the smallest id."""
    order = np.lexsort((ids[y], apart, x))
    x, y, apart = x[order], y[order], apart[order]
    x, first = np.unique(x, return_index=True)
    return x, y[first], apart[first]


def likely(x, y, apart, regs, n, percent: int, s: Sketch, most_unequal: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs whose registers don't rule the similarity out."""
    ok = np.flatnonzero((regs[x] != regs[y]).sum(axis=1) <= most_unequal)
    if len(ok):
        ok = ok[can_be(regs[x[ok]], regs[y[ok]], n[x[ok]], n[y[ok]], percent, s.base)]
    return x[ok], y[ok], apart[ok]


def across(members: DataFrame, sets: DataFrame, roots: DataFrame, s: Sketch, percent: int, best: bool) -> DataFrame:
    """Different pairs (a, b) of sets that share a bucket of ``members`` (k, band, fp, ref), lie in different components of ``roots`` (node, root), differ in ``ref`` and can be similar.

    The members of a bucket's largest class, of one component or one ref, are no partners of each other: chunks of the others meet all chunks, its own chunks meet only
    those of the others."""
    tied = members.join(roots, F.col("fp") == F.col("node"), "left").select("k", "band", "fp", "ref", F.coalesce("root", "fp").alias("root"))
    tied = materialize(tied, "tied")
    classes = tied.select("k", F.explode(F.array(F.struct(F.lit(False).alias("by_ref"), F.col("root").alias("is")), F.struct(F.lit(True).alias("by_ref"), F.col("ref").alias("is")))).alias("c"))
    sizes = classes.groupBy("k", "c").agg(F.count("*").alias("m")).groupBy("k").agg(F.max(F.struct("m", "c")).alias("top"), (F.sum("m") / 2).cast("bigint").alias("m"))
    up = lambda c: F.ceil(c / CHUNK).cast("int")
    sizes = sizes.filter("m > top.m").select("k", F.col("top.c").alias("_top"), up(F.col("m") - F.col("top.m")).alias("few"), up(F.col("top.m")).alias("many"))
    cells = _meeting(tied.join(sizes, "k"), F.when(F.col("_top.by_ref"), F.col("ref")).otherwise(F.col("root")) == F.col("_top.is"))
    cells = cells.select("k", "band", "fp", "root", "ref", "chunk", "ci", "cj")
    rows = cells.join(sets.select("fp", "n", "regs"), "fp")
    buckets = rows.groupBy("k", "band", "ci", "cj").agg(F.collect_list(F.struct("fp", "n", "root", "ref", "chunk", "regs")).alias("members"))
    buckets = buckets.filter((F.size(F.array_distinct("members.root")) > 1) & (F.size(F.array_distinct("members.ref")) > 1)).drop("k")
    pairs = buckets.mapInArrow(lambda b: released(_across(b, percent, s, best)), "a bigint, b bigint, apart bigint")
    if best:
        pairs = pairs.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(each: DataFrame, docs: DataFrame, s: Sketch, percent: int, near: int | None = None) -> DataFrame:
    """Links (a, b) between keys of sets of ``each`` (written rows of :func:`sketches`) whose components are those of all similar pairs.

    With ``near`` the pairs that SimHash's pigeonhole blocks find within so many bits of ``print`` are confirmed too, and bands are asked for what these and the references leave apart."""
    sets = materialize(each.filter("n > 0").groupBy("fp").agg(F.min_by(F.struct("doc_id", "text_key", "n", "regs", "print"), "text_key").alias("r")).select("fp", "r.*"), "sets")
    entries = sets.select("fp", F.posexplode(band_keys(s)).alias("band", "k"))
    shared = entries.groupBy("k").agg(F.min("fp").alias("least"), F.count("*").alias("_m")).filter("_m > 1")
    members = materialize(entries.join(shared.select("k", "least"), "k"), "members")
    pairs = materialize(members.filter("fp <> least").groupBy(F.col("fp").alias("b")).agg(F.min("least").alias("a")).select("a", "b"), "pairs")
    of_prints = None if near is None else materialize(simhash.candidates(sets.select("fp", "print"), near), "print-pairs")
    needed = members.select("fp") if near is None else members.select("fp").unionByName(of_prints.select(F.explode(F.array("a", "b")).alias("fp")))
    wanted = sets.join(needed.distinct(), "fp", "left_semi").select("fp", "doc_id", "text_key")
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"), F.col("text").cast("binary").alias("text"))
    texts = rows.join(wanted, (F.col("_key") == F.col("text_key")) & F.col("_id").eqNullSafe(F.col("doc_id"))).select("fp", "text")
    texts = materialize(texts.groupBy("fp").agg(F.first("text").alias("text")), "texts")
    compared = confirm(pairs, texts, percent, differences=True)
    tried, found, best = pairs, compared.filter("linked").select("a", "b"), True
    if near is not None:
        tried, found = tried.unionByName(of_prints), confirm(of_prints, texts, percent).unionByName(found)
    found = found.unionByName(materialize(of_reference(compared, components(found), percent), "similar"))
    refs = compared.filter("diff IS NOT NULL").select(F.col("b").alias("fp"), F.col("a").alias("ref"))
    members = members.join(refs, "fp", "left").select("k", "band", "fp", F.coalesce("ref", "fp").alias("ref"))
    while True:
        fresh = materialize(across(members, sets, components(found), s, percent, best).join(tried, ["a", "b"], "left_anti"), "pairs")
        more = confirm(fresh, texts, percent)
        tried, found = tried.unionByName(fresh), found.unionByName(more)
        if not best:
            return found
        best = 10 * more.count() >= fresh.count() > 0


def groups(docs: DataFrame, percent: int, s: Sketch = Sketch(), near: int | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, text_key, n (size of its set) and root, the smallest key of a set in its component; empty sets share one."""
    each = materialize(sketches(docs, s, near is not None), "sketches")
    roots = components(links(each, docs, s, percent, near))
    return each.join(roots, F.col("fp") == F.col("node"), "left").select("doc_id", "text_key", "n", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, percent: int = 85, s: Sketch = Sketch()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_shingles (different five-word shingles; a text of fewer words is one),
    component_id (the smallest doc_id that can be reached over links of ``percent`` * union <= 100 * intersection, itself included), kept (whether that
    is its own id), root (the component itself, as its smallest key of a set; null for a text without words).

    A null text, and one without words, has an empty set and is linked with nothing, not even with its like. Copies and repeated rows share a set.
    A null id takes part, and is a component's id only where no other is; such rows are kept. An empty table gives no rows. Texts of any length are
    taken whole. Sets are told apart by 64 bits, as are shingles.
    """
    tied = groups(docs, percent, s)
    ids = tied.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("_least"), F.count("*").alias("_m")).filter("_m > 1")
    out = tied.filter("n > 0").join(ids.select("root", "_least"), "root", "left").select(
        "doc_id", "n", "root", F.coalesce("_least", "doc_id").alias("component_id"))
    out = out.unionByName(tied.filter("n = 0").select("doc_id", "n", F.lit(None).cast("bigint").alias("root"), F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "root")


def keep_one(docs: DataFrame, percent: int = 80, s: Sketch = Sketch(), near: int | None = None) -> DataFrame:
    """The rows of ``docs`` without near copies, with all their columns: of each component one row stays, one with the smallest doc_id, a null id
    only where no other is. Of rows with the same id and text one stays, whichever its other columns are, the same in every run. Texts without words (null, empty) are
    one component. An empty table gives no rows. ``near`` as in :func:`links`; the rows don't depend on it.
    """
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_key")).alias("m")
    found = groups(docs, percent, s, near).groupBy("root").agg(least).select("m.doc_id", "m.text_key")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"))
    rows = rows.join(found, rows["_id"].eqNullSafe(found["doc_id"]) & (rows["_key"] == found["text_key"]), "left_semi")
    return rows.groupBy("_id", "_key").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row")).select("_row.*")
