"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document with a smaller id are removed.

A suffix array over a corpus can't be built in one place, so equal strings are first brought together. Out of every window of 50 bytes one 32-byte gram is
chosen by its content alone (the place of the smallest 13-byte hash of the window, modulo 19), about one gram for 18 bytes. Equal windows choose
the same gram, so they meet in the bucket of the gram's hash.

1. Documents are written as pages of about a megabyte. Each page sends the hashes of its grams, each once, to their buckets, and gets back a bit for each:
   whether another document has it too.
2. Each page sends the surroundings of its shared grams (68 bytes, each different one once, with the smallest id in the page) to the buckets.
   A bucket builds the suffix array of its surroundings by two-stage sorting. Neighbours with a common prefix of 50 bytes
   form runs; the smallest id of a run is the first document with that string. The page gets back which starts are covered.
3. The pages turn covered starts into spans and remove them.

Copies in a page travel once, and a bucket's size doesn't depend on how often a passage repeats inside a page. Pages travel compressed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stockweave.functions.runtime import materialize
from stockweave.llm.suffix_array import common_prefix, suffix_array, words_at

LENGTH, GRAM, TINY = 50, 32, 13  # of a string, a gram, and what a gram is chosen by
STEP = LENGTH - GRAM + 1  # grams of a string; a string's place in a gram's surroundings is below it
AROUND = LENGTH + STEP - 1  # bytes that a gram's strings cover
PAGE, PAGE_DOCS = 1 << 20, 4096  # bytes and documents of a page
BUCKET = 6 << 20  # bytes of text for each bucket
NO_ID = np.iinfo(np.int64).min  # stands for a null id, which is smaller than all


def squeeze(data: bytes, level: int = 3) -> bytes:
    """Compressed, with the size in front."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(data, asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def grams(data: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Places of the chosen grams of a page's ``data``, whose documents end at ``ends``; strings never cross documents."""
    chosen = []
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)) if len(data) <= block else None
    for lo in range(0, max(len(data) - LENGTH + 1, 0), block):
        part = data[lo:lo + block + LENGTH - 1]
        words = words_at(part)
        n = len(part) - TINY + 1
        tiny = mix(words[:n], 1) + mix(words[TINY - 8:TINY - 8 + n], 2)
        key = (tiny >> np.uint64(21) << np.uint64(21)) | np.arange(n, dtype=np.uint64)  # of equal hashes the first
        size, want = 1, LENGTH - TINY + 1
        while 2 * size <= want:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        if size < want:
            key = np.minimum(key[:size - want], key[want - size:])
        start = np.arange(len(part) - LENGTH + 1)
        least = (key[:len(start)] & np.uint64((1 << 21) - 1)).astype(np.int64)
        if doc is not None:
            ok = doc[lo + start] == doc[lo + start + LENGTH - 1]
        else:
            ok = np.searchsorted(ends, lo + start, side="right") == np.searchsorted(ends, lo + start + LENGTH - 1, side="right")
        taken = np.zeros(len(part), bool)
        taken[(start + (least - start) % STEP)[ok]] = True
        chosen.append(np.nonzero(taken)[0] + lo)
    return np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)


class Page:
    """A page's documents and its grams, which were chosen when it was written."""

    def __init__(self, blob: bytes, ids: np.ndarray, lengths: np.ndarray, gaps: bytes):
        self.data = np.frombuffer(unsqueeze(blob), np.uint8)
        self.ids, self.ends = ids, np.cumsum(lengths)
        self.places = np.cumsum(np.frombuffer(unsqueeze(gaps), "<u4"), dtype=np.int64)
        four = self.data[self.places[:, None] + np.arange(GRAM)].view("<u8") if len(self.places) else np.zeros((0, 4), np.uint64)
        h = mix(four[:, 0], 3)
        for k in (1, 2, 3):
            h = mix(h ^ four[:, k], 3 + k)
        self.hash = h >> np.uint64(1) << np.uint64(1)  # the last bit says that two documents of the page share it
        self.doc = np.searchsorted(self.ends, self.places, side="right")
        self.unique, self.which = np.unique(self.hash, return_inverse=True)

    def buckets(self, n: int) -> np.ndarray:
        """Bucket of each different hash; ascending, as the hashes are."""
        return ((self.unique >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)

    def several(self) -> np.ndarray:
        """Whether two documents of the page have a hash."""
        low, high = np.full(len(self.unique), len(self.ids)), np.full(len(self.unique), -1)
        np.minimum.at(low, self.which, self.doc)
        np.maximum.at(high, self.which, self.doc)
        return low < high

    def surroundings(self, shared: np.ndarray):
        """Of the grams whose hash is shared: (bucket order) rows of bytes, where text begins and ends in them, smallest id, and for
        each gram its row. Equal surroundings of the page are one row."""
        at = np.nonzero(shared[self.which])[0]
        begin = self.places[at] - (STEP - 1)
        doc = self.doc[at]
        first = (self.ends[doc] - np.diff(self.ends, prepend=0)[doc])
        lo, hi = np.maximum(first - begin, 0).astype(np.uint8), np.minimum(self.ends[doc] - begin, AROUND).astype(np.uint8)
        spot = begin[:, None] + np.arange(AROUND)
        inside = (np.arange(AROUND) >= lo[:, None]) & (np.arange(AROUND) < hi[:, None])
        rows = np.where(inside, self.data[np.clip(spot, 0, max(len(self.data) - 1, 0))], 0).astype(np.uint8) if len(at) else np.zeros((0, AROUND), np.uint8)
        wide = np.zeros((len(at), 72), np.uint8)
        wide[:, :AROUND], wide[:, AROUND], wide[:, AROUND + 1] = rows, lo, hi
        keys = wide.view(">u8")
        order = np.lexsort((*[keys[:, k] for k in range(8, -1, -1)], self.which[at]))
        new = np.ones(len(at), bool)
        if len(at):
            a, b = order[1:], order[:-1]
            new[1:] = (self.which[at][a] != self.which[at][b]) | (keys[a] != keys[b]).any(axis=1)
        row = np.empty(len(at), np.int64)
        row[order] = np.cumsum(new) - 1
        heads = order[new]
        least = np.full(len(heads), np.iinfo(np.int64).max)
        np.minimum.at(least, row, self.ids[doc])
        return at, row, rows[heads], lo[heads], hi[heads], least, self.which[at][heads]


def _pages(batches):
    """Rows (page, ids, lengths, size, blob, gaps): about PAGE bytes of documents, compressed, and the places of their grams, each as its distance from the one
    before; a longer document is a page by itself."""
    from pyspark import TaskContext

    task, number = TaskContext.get().partitionId(), 0
    names = ["page", "ids", "lengths", "size", "blob", "gaps"]

    def page(ids, texts):
        joined = b"".join(texts)
        places = grams(np.frombuffer(joined, np.uint8), np.cumsum([len(t) for t in texts]))
        return pa.RecordBatch.from_arrays([
            pa.array([(task << 32) + number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, pa.int64())),
            pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([len(joined)], pa.int64()),
            pa.array([squeeze(joined, 6)], pa.binary()),
            pa.array([squeeze(np.diff(places, prepend=0).astype("<u4").tobytes())], pa.binary())], names)

    ids, texts, held = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            t = t or b""
            if texts and (held + len(t) > PAGE or len(texts) >= PAGE_DOCS):
                yield page(ids, texts)
                ids, texts, held, number = [], [], 0, number + 1
            ids.append(i)
            texts.append(t)
            held += len(t)
    if texts:
        yield page(ids, texts)


def _page(batch, row: int) -> Page:
    get = lambda name: batch.column(name)[row]
    ids = np.array([NO_ID if i is None else i for i in get("ids").as_py()], np.int64)
    return Page(get("blob").as_py(), ids, np.asarray(get("lengths").values, np.int64), get("gaps").as_py())


def _rows(page: int, parts, names):
    """A batch with one row for each bucket: (bucket, page, blobs...)."""
    columns = [pa.array([p[0] for p in parts], pa.int64()), pa.array([page] * len(parts), pa.int64())]
    columns += [pa.array([p[k] for p in parts], pa.binary()) for k in range(1, len(names) - 1)]
    return pa.RecordBatch.from_arrays(columns, names)


def _asked(batches, n: int):
    for batch in batches:
        for i in range(batch.num_rows):
            page = _page(batch, i)
            marked = page.unique | page.several().astype(np.uint64)
            found, first = np.unique(page.buckets(n), return_index=True)
            ends = np.append(first[1:], len(marked))
            yield _rows(batch.column("page")[i].as_py(), [(int(b), marked[x:y].tobytes()) for b, x, y in zip(found, first, ends)], ["bucket", "page", "hashes"])


def _shared(table: pa.Table) -> pa.Table:
    """For one bucket: a bit for each hash of each page, whether two documents have it."""
    blobs = table.column("hashes").to_pylist()
    marked = np.frombuffer(b"".join(blobs), np.uint64)
    values, which, count = np.unique(marked >> np.uint64(1), return_inverse=True, return_counts=True)
    many = count > 1
    many[which[(marked & np.uint64(1)) == 1]] = True
    sizes = np.array([len(b) // 8 for b in blobs], np.int64)
    bits = np.split(many[which], np.cumsum(sizes)[:-1])
    return pa.table([table.column("bucket"), table.column("page"), pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())], names=["bucket", "page", "bits"])


def _answers(cell, n_bits_of: np.ndarray) -> np.ndarray:
    """Bits of all buckets of a page, in the order of its hashes."""
    by = {a["bucket"]: a["bits"] for a in cell or []}
    found, counts = np.unique(n_bits_of, return_counts=True)
    parts = [np.unpackbits(np.frombuffer(by[int(b)], np.uint8), count=int(c)).astype(bool) for b, c in zip(found, counts)]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def _sent(batches, n: int):
    for batch in batches:
        for i in range(batch.num_rows):
            page = _page(batch, i)
            buckets = page.buckets(n)
            shared = _answers(batch.column("answers")[i].as_py(), buckets)
            _, _, rows, lo, hi, least, which = page.surroundings(shared)
            found, first = np.unique(buckets[which], return_index=True)
            ends = np.append(first[1:], len(which))
            parts = [(int(b), squeeze(rows[x:y].tobytes()), squeeze(np.stack([lo[x:y], hi[x:y]]).tobytes()), squeeze(least[x:y].tobytes())) for b, x, y in zip(found, first, ends)]
            if parts:
                yield _rows(batch.column("page")[i].as_py(), parts, ["bucket", "page", "rows", "bounds", "ids"])


def first_ids(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row and each of its STEP starts: the smallest id of a row that holds the same LENGTH bytes anywhere; the row's own id
    where no string starts."""
    keys = np.zeros((len(rows), 72), np.uint8)
    keys[:, :AROUND], keys[:, AROUND], keys[:, AROUND + 1] = rows, lo, hi
    keys = keys.view(">u8")
    order = np.lexsort(tuple(keys[:, k] for k in range(8, -1, -1)))
    new = np.ones(len(rows), bool)
    new[1:] = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
    which = np.empty(len(rows), np.int64)
    which[order] = np.cumsum(new) - 1
    heads = order[new]
    least = np.full(len(heads), np.iinfo(np.int64).max)
    np.minimum.at(least, which, ids)
    each = np.ascontiguousarray(rows[heads])
    ranked = suffix_array(each, LENGTH, STEP)
    row, start = ranked // AROUND, ranked % AROUND
    ok = (start < STEP) & (start >= lo[heads][row]) & (start + LENGTH <= hi[heads][row])
    ranked, row, start = ranked[ok], row[ok], start[ok]
    out = np.repeat(least[:, None], STEP, axis=1)
    if len(ranked):
        words = words_at(each.reshape(-1))
        opens = np.concatenate([[True], ~common_prefix(ranked[1:], ranked[:-1], words, LENGTH)])
        runs = np.minimum.reduceat(least[row], np.nonzero(opens)[0])
        out[row, start] = runs[np.cumsum(opens) - 1]
    return out[which]


def _covered(table: pa.Table) -> pa.Table:
    """For one bucket: for each row of each page the starts, as bits, whose string begins in a document before the row's first."""
    blobs = lambda name, kind: [np.frombuffer(unsqueeze(b), kind) for b in table.column(name).to_pylist()]
    each = blobs("ids", np.int64)
    sizes, ids = np.array([len(x) for x in each], np.int64), np.concatenate(each)
    lo, hi = np.concatenate([b.reshape(2, -1) for b in blobs("bounds", np.uint8)], axis=1).astype(np.int64)
    earlier = first_ids(np.concatenate(blobs("rows", np.uint8)).reshape(-1, AROUND), lo, hi, ids) < ids[:, None]
    masks = (earlier << np.arange(STEP)).sum(axis=1).astype("<u4")
    parts = np.split(masks, np.cumsum(sizes)[:-1])
    return pa.table([table.column("bucket"), table.column("page"), pa.array([p.tobytes() for p in parts], pa.binary())], names=["bucket", "page", "masks"])


def spans_of(page: Page, shared: np.ndarray, answers, buckets: np.ndarray) -> np.ndarray:
    """Removed bytes of a page, as booleans."""
    at, row, _, lo, hi, least, which = page.surroundings(shared)
    by = {a["bucket"]: a["masks"] for a in answers or []}
    masks = np.frombuffer(b"".join(by[int(b)] for b in np.unique(buckets[which])), "<u4") if len(which) else np.zeros(0, "<u4")
    starts = np.arange(STEP)
    whole = (starts >= lo[:, None]) & (starts + LENGTH <= hi[:, None])
    earlier = (masks[:, None] >> starts.astype("<u4") & 1).astype(bool)
    # a document after the page's first with the same surroundings finds all its strings there
    later = page.ids[page.doc[at]] > least[row]
    hit = whole[row] & (later[:, None] | earlier[row])
    begin = (page.places[at] - (STEP - 1))[:, None] + starts
    edge = np.zeros(len(page.data) + 1, np.int64)
    np.add.at(edge, begin[hit], 1)
    np.add.at(edge, begin[hit] + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


def _removed(batches, n: int, texts: bool):
    for batch in batches:
        for i in range(batch.num_rows):
            page = _page(batch, i)
            buckets = page.buckets(n)
            shared = _answers(batch.column("answers")[i].as_py(), buckets)
            gone = spans_of(page, shared, batch.column("covered")[i].as_py(), buckets)
            ids, out = batch.column("ids")[i].values, []
            for a, b in zip((page.ends - np.diff(page.ends, prepend=0)).tolist(), page.ends.tolist()):
                g = gone[a:b]
                kept = page.data[a:b][~g].tobytes()
                out.append((b - a, int(g.sum()), int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept if texts else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def dedup(docs: DataFrame, texts: bool = True) -> DataFrame:
    """Per row of ``docs`` (doc_id bigint, text; other columns are ignored): doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``texts`` kept (the bytes
    that are left, which may end inside a character).

    A null text is empty. Rows with one id don't remove each other's bytes; a null id is smaller than all. Texts shorter than a string stay. An empty table gives
    no rows.
    """
    spark = docs.sparkSession
    pages = materialize(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
                        .mapInArrow(_pages, "page long, ids array<long>, lengths array<long>, size long, blob binary, gaps binary"), "pages")
    size = pages.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))
    deal = lambda df: df.repartition(n, "bucket").groupBy("bucket")
    by_page = lambda df, blob, out: df.groupBy("page").agg(F.collect_list(F.struct("bucket", blob)).alias(out))
    asked = pages.mapInArrow(lambda b: _asked(b, n), "bucket long, page long, hashes binary")
    answers = by_page(materialize(deal(asked).applyInArrow(_shared, "bucket long, page long, bits binary"), "answers"), "bits", "answers")
    sent = pages.join(answers, "page", "left").mapInArrow(lambda b: _sent(b, n), "bucket long, page long, rows binary, bounds binary, ids binary")
    covered = by_page(materialize(deal(sent).applyInArrow(_covered, "bucket long, page long, masks binary"), "covered"), "masks", "covered")
    out = (pages.join(answers, "page", "left").join(covered, "page", "left")
           .mapInArrow(lambda b: _removed(b, n, texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))
    return out if texts else out.drop("kept")
