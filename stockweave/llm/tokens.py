"""Token ids of whole texts, by a public byte-level BPE file of the ``tokenizers`` library.

Encoding one long text costs several microseconds a word, and most words were seen before. ``Encoder`` therefore encodes each distinct chunk once per
Python worker and keeps its ids. A chunk is a run of ASCII white space with what follows up to the next; the splitting pattern of a byte-level BPE never
joins a character that isn't white space to white space after it, so the ids of a text are those of its chunks, one after the other. Texts for which that is
not certain (other white space right before an ASCII one, special tokens) are encoded whole.

Chunks are found, hashed and looked up in arrays of a batch's bytes; Python sees a chunk only when it is new. A hash only proposes: the bytes
of every chunk are compared with those that the ids were made from.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "byte_bpe_50k.json"  # a name known to public_tokenizers.path, or a path
CACHE_CHUNKS = 1_000_000  # distinct chunks a worker keeps, about 90 bytes each; then it begins anew, which changes no result
BLOCK = 1 << 20  # bytes that are hashed or compared at a time

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # a number for each byte
_ODD = np.uint64(0xD1342543DE82EF95)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


def blocks(lengths: np.ndarray):
    """Runs (first, last) of chunks with about BLOCK bytes, one chunk at least."""
    ends, first = np.cumsum(lengths), 0
    while first < len(lengths):
        begin = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, begin + BLOCK, side="right")))
        yield first, last
        first = last


def inner(lengths: np.ndarray) -> np.ndarray:
    """The place of each byte in its chunk."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1])) - np.repeat(ends - lengths, lengths)


def hash_chunks(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each chunk; the chunks lie one after the other."""
    out = np.empty(len(starts), np.uint64)
    powers = np.cumprod(np.full(int(lengths.max(initial=1)), _ODD, np.uint64))
    for a, b in blocks(lengths):
        at = inner(lengths[a:b])
        out[a:b] = np.add.reduceat(_BYTE[text[starts[a]:starts[a] + len(at)]] * powers[at], starts[a:b] - starts[a])
    return _mixed(out)


def other_space(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether white space beyond ASCII ends right before each place."""
    p1, p2, p3 = (text[np.maximum(at - k, 0)] for k in (1, 2, 3))
    two = (p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))
    three = (((p3 == 0xE1) & (p2 == 0x9A) & (p1 == 0x80)) | ((p3 == 0xE2) & (p2 == 0x80) & (((p1 >= 0x80) & (p1 <= 0x8A)) | np.isin(p1, (0xA8, 0xA9, 0xAF))))
             | ((p3 == 0xE2) & (p2 == 0x81) & (p1 == 0x9F)) | ((p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x80)))
    return two | three


def grown(x: np.ndarray, size: int) -> np.ndarray:
    """The array, made longer until it has ``size`` entries."""
    return x if size <= len(x) else np.concatenate([x, np.zeros(max(size, 2 * len(x)) - len(x), x.dtype)])


class Encoder:
    """Ids of texts. ``encode(texts)`` takes bytes in UTF-8 and gives one flat uint32 array and the number of ids of each text."""

    def __init__(self, vocabulary: str = VOCABULARY, cache_chunks: int = CACHE_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.limit = cache_chunks
        self.wide = max(self.tokenizer.get_vocab().values()) >= 1 << 16
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.widths = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, np.int64)  # bytes of each id; one letter stands for each byte
        self.widths[list(vocab.values())] = [len(t) for t in vocab]
        self.clear()

    def clear(self) -> None:
        self.known = 0
        self.slots = np.zeros(1 << 12, np.int32)  # an open table of codes + 1, by hash
        self.hashes = np.zeros(1 << 10, np.uint64)
        self.ids, self.ends = np.zeros(1 << 12, np.uint32 if self.wide else np.uint16), np.zeros(1 << 10, np.int64)
        self.bytes, self.stops = np.zeros(1 << 13, np.uint8), np.zeros(1 << 10, np.int64)

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """The code of each hash, -1 where it is new."""
        mask, out, open_ = len(self.slots) - 1, np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        at = (hashes & np.uint64(mask)).astype(np.int64)
        while len(open_):
            code = self.slots[at] - 1
            used = code >= 0
            hit = used & (self.hashes[code] == hashes[open_])
            out[open_[hit]] = code[hit]
            on = used & ~hit
            open_, at = open_[on], (at[on] + 1) & mask
        return out

    def place(self, codes: np.ndarray) -> None:
        """Enter different codes in the table."""
        mask = len(self.slots) - 1
        at = (self.hashes[codes] & np.uint64(mask)).astype(np.int64)
        while len(codes):
            free = np.flatnonzero(self.slots[at] == 0)
            won = free[np.unique(at[free], return_index=True)[1]]
            self.slots[at[won]] = codes[won] + 1
            left = np.ones(len(codes), bool)
            left[won] = False
            codes, at = codes[left], (at[left] + 1) & mask

    def keep(self, hashes: np.ndarray, raw: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Learn new chunks of different hashes, whose bytes lie one after the other in ``raw``; their codes."""
        order, flat, counts = self.learn(raw, lengths)
        begins = np.cumsum(lengths) - lengths
        lengths, n = lengths[order], self.known + len(order)
        raw = raw[inner(lengths) + np.repeat(begins[order], lengths)]
        used, written = (int(x[self.known - 1]) if self.known else 0 for x in (self.ends, self.stops))
        self.ids, self.bytes = grown(self.ids, used + len(flat)), grown(self.bytes, written + len(raw))
        self.hashes, self.ends, self.stops = (grown(x, n) for x in (self.hashes, self.ends, self.stops))
        self.ids[used:used + len(flat)], self.bytes[written:written + len(raw)] = flat, raw
        self.hashes[self.known:n] = hashes[order]
        self.ends[self.known:n], self.stops[self.known:n] = used + np.cumsum(counts), written + np.cumsum(lengths)
        codes = np.empty(len(order), np.int64)
        codes[order] = np.arange(self.known, n)
        before, self.known = self.known, n
        if 2 * n > len(self.slots):
            self.slots, before = np.zeros(1 << (4 * n).bit_length(), np.int32), 0
        self.place(np.arange(before, n))
        return codes

    def learn(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of chunks, their ids in that order and how many each has.

        Chunks that begin with ASCII white space and end without any make one text, whose ids are theirs; the bytes of the ids tell where a chunk ends."""
        ends = np.cumsum(lengths)
        apart = ~_SPACE[raw[ends - lengths]] | _SPACE[raw[ends - 1]] | other_space(raw, ends)
        joined, single = np.flatnonzero(~apart), np.flatnonzero(apart)
        flat, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(joined):
            text = raw[np.repeat(~apart, lengths)].tobytes()
            flat = np.asarray(self.tokenizer.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.int64)
            reach, want = np.cumsum(self.widths[flat]), np.cumsum(lengths[joined])
            at = np.searchsorted(reach, want)
            if reach[-1] == want[-1] and (reach[at] == want).all():
                counts = np.diff(np.append(-1, at))
            else:  # an id across chunks: not with the patterns known here
                flat, single, joined = flat[:0], np.append(joined, single), joined[:0]
        if len(single):
            texts = [raw[e - n:e].tobytes().decode("utf-8", "replace") for e, n in zip(ends[single].tolist(), lengths[single].tolist())]
            each = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            flat, counts = np.concatenate([flat, np.array([i for ids in each for i in ids], np.int64)]), np.append(counts, [len(ids) for ids in each])
        return np.append(joined, single), flat, counts.astype(np.int64)

    def differ(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Chunks whose bytes aren't those of their code."""
        stops = self.stops[codes]
        begins = np.where(codes > 0, self.stops[np.maximum(codes - 1, 0)], 0)
        bad = stops - begins != lengths
        for a, b in blocks(lengths):
            own = lengths[a:b]
            at = np.minimum(inner(own) + np.repeat(begins[a:b], own), len(self.bytes) - 1)
            wrong = np.flatnonzero(self.bytes[at] != text[starts[a]:starts[a] + len(at)])
            bad[a + np.searchsorted(np.cumsum(own), wrong, side="right")] = True
        return np.flatnonzero(bad)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.known > self.limit:
            self.clear()
        whole, given = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}, texts
        texts = [b"" if i in whole else t for i, t in enumerate(texts)]
        text = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        space = _SPACE[text]
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        at = np.flatnonzero(begin)
        whole.update(np.searchsorted(ends, at[other_space(text, at)], side="right").tolist())
        begin[(ends - [len(t) for t in texts])[[len(t) > 0 for t in texts]]] = True
        starts = np.flatnonzero(begin)
        lengths = np.diff(np.append(starts, len(text)))
        hashes = hash_chunks(text, starts, lengths)
        codes = self.codes(hashes)
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            fresh, first, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
            own = lengths[missing[first]]
            raw = text[inner(own) + np.repeat(starts[missing[first]], own)]
            codes[missing] = self.keep(fresh, raw, own)[which]
        whole.update(np.searchsorted(ends, starts[self.differ(text, starts, lengths, codes)], side="right").tolist())
        stops = self.ends[codes]
        begins = np.where(codes > 0, self.ends[np.maximum(codes - 1, 0)], 0)
        sizes = stops - begins
        through = np.cumsum(sizes)
        total = int(through[-1]) if len(through) else 0
        flat = self.ids[np.arange(total) + np.repeat(begins - (through - sizes), sizes)].astype(np.uint32)
        reach = np.concatenate([[0], through])[np.searchsorted(starts, ends)]
        counts = np.diff(np.concatenate([[0], reach]))
        if whole:
            parts = np.split(flat, reach[:-1])
            for i in sorted(whole):
                parts[i] = np.asarray(self.tokenizer.encode(given[i].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
                counts[i] = len(parts[i])
            flat = np.concatenate(parts)
        return flat, counts


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """One encoder for each Python worker and vocabulary, kept between tasks."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_kept_encoders", {})
    if vocabulary not in kept:
        kept[vocabulary] = Encoder(vocabulary)
    return kept[vocabulary]


def with_end(flat: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with an end id after each text, and where each text ends in them."""
    ends = np.cumsum(counts + 1)
    ids = np.full(int(ends[-1]), end, np.uint32)
    inner = np.ones(len(ids), bool)
    inner[ends - 1] = False
    ids[inner] = flat
    return ids, ends


def crc32(ids: np.ndarray) -> int:
    """Of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def runs(column, most: int = 2_000_000):
    """Start, end and texts (UTF-8 bytes; null: empty) of runs of a column with about ``most`` bytes, so that one call's arrays stay small."""
    column = column.cast(pa.large_binary())
    sizes = [*pc.fill_null(pc.binary_length(column), 0).to_pylist(), most + 1]
    start, size = 0, 0
    for i, n in enumerate(sizes):
        if i > start and size + n > most:
            yield start, i, [t or b"" for t in column.slice(start, i - start).to_pylist()]
            start, size = i, 0
        size += n
