"""Fill-in-the-middle by block rotations inside one byte buffer.

Two cuts split a text into prefix, middle and suffix. The text is put into a bytearray once, the three sentinels are inserted at its cuts from
the back, and two neighbouring blocks change places by three reversals: of the first, of the second, of both together. No piece is ever copied into a
new text. Rotating back by the other block's length and deleting the sentinels gives the text again, byte by byte.

Cuts are found by a scan over bytes: a unit ends where a word does, and white space at the end is a unit of its own. White space is ASCII,
so a cut never falls inside a character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
BLOCK = 1 << 16  # bytes that a reversal exchanges at a time

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def reverse(view: np.ndarray, start: int, stop: int) -> None:
    """Reverse view[start:stop] in place, by blocks from both ends."""
    while stop - start > 1:
        n = min(BLOCK, (stop - start) // 2)
        head = view[start:start + n].copy()
        view[start:start + n] = view[stop - n:stop][::-1]
        view[stop - n:stop] = head[::-1]
        start, stop = start + n, stop - n


def rotate(buffer: bytearray, start: int, middle: int, stop: int) -> None:
    """Exchange the blocks buffer[start:middle] and buffer[middle:stop] in place."""
    view = np.frombuffer(buffer, np.uint8)
    reverse(view, start, middle)
    reverse(view, middle, stop)
    reverse(view, start, stop)


def unit_ends(text: bytes) -> np.ndarray:
    """Where the units of a text end: each word with the white space before it, then white space that is left."""
    if not text:
        return np.zeros(0, np.int64)
    space = _SPACE[np.frombuffer(text, np.uint8)]
    ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    return np.append(ends, len(text)) if space[-1] else ends


def characters(text: bytes, start: int, stop: int) -> int:
    """Code points of text[start:stop]: bytes that don't go on a character."""
    return int(((np.frombuffer(text, np.uint8, stop - start, start) & 0xC0) != 0x80).sum()) if stop > start else 0


def move(text: bytes, first: int, second: int, form: str) -> bytearray:
    """The text with its middle text[first:second] last and the sentinels before their pieces."""
    out = bytearray(text)
    out[second:second] = SUFFIX
    out[first:first] = MIDDLE
    out[0:0] = PREFIX
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    rotate(out, middle if form == PSM else 0, suffix, len(out))
    return out


def restore(output: bytes, form: str) -> bytearray:
    """The text that :func:`move` was given: the blocks rotated back, the sentinels deleted. A plain output is its text."""
    out = bytearray(output)
    if form == PLAIN:
        return out
    middle = out.index(MIDDLE)
    if form == PSM:
        suffix = out.index(SUFFIX)
        rotate(out, suffix, middle, len(out))
    else:  # the suffix comes first
        rotate(out, 0, out.index(PREFIX), len(out))
    middle, suffix = out.index(MIDDLE), out.index(SUFFIX)
    del out[suffix:suffix + len(SUFFIX)]
    del out[middle:middle + len(MIDDLE)]
    del out[:len(PREFIX)]
    return out


def draw(doc_id, seed: str) -> list[int]:
    """The first four groups of eight hex digits of the id's SHA-256; a null id has no digits after the colon."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * i:4 * i + 4], "big") for i in range(4)]


def arrange(doc_id, text: bytes, seed: str, share: int, spm_share: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one document."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draw(doc_id, seed)
    if not text or h3 % 100 >= share or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, PLAIN, None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, second = (int(ends[k - 1]) if k else 0 for k in (low, high))
    form = SPM if h4 % 100 < spm_share else PSM
    return n, form, characters(text, 0, first), characters(text, first, second), move(text, first, second, form)


def slices(batch: pa.RecordBatch, most: int = 1 << 24):
    """The batch in slices of about ``most`` bytes of text, so that outputs stay small beside it."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def transform(docs: DataFrame, seed: str = "42", share: int = 50, spm_share: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n (units), form, prefix_chars, middle_chars (null where
    plain), output (binary UTF-8).

    Of 100 documents about ``share`` are rearranged, of these ``spm_share`` with the suffix first. What happens to a row follows from its doc_id and text
    alone, so reruns, ties and repeated rows agree. A null text is empty; an empty text, or one that holds a sentinel, stays plain. A null id is drawn as an id
    without digits. An empty table gives no rows. Texts of any length are taken whole; a task holds one batch of them.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = [arrange(i, t or b"", seed, share, spm_share) for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())]
                n, form, prefix, middle, output = zip(*found)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                                                  pa.array(map(bytes, output), pa.binary())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary")


def restored(output="output", form="form"):
    """The texts (binary) that outputs of :func:`transform` came from, rebuilt from output and form alone."""
    @F.arrow_udf("binary")
    def texts(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        return pa.array([None if o is None else bytes(restore(o, f)) for o, f in zip(outputs.to_pylist(), forms.to_pylist())], pa.binary())

    return texts(F.col(output), F.col(form))
