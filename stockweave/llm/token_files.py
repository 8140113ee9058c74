"""Token ids in files of patched frame-of-reference blocks.

The rows of a file table (Parquet in the shared folder, written by Spark's committer) are chunks of consecutive documents. A chunk's payload
is a sequence of blocks of 256 ids: the block's minimum is subtracted, the differences are packed at the bit width that ``percent`` of them need,
and the few that need more are stored whole in an exception list. ``index`` holds where each block starts in the payload, so any
block can be decoded by itself. Documents are dealt out by ranges of doc_id, so that the tables's shards in order hold the corpus in order; the place
of a shard's first id is a prefix sum over one row for each shard.

Block: u4 minimum, u1 width, u1 0, u2 number of ids, u2 number of exceptions, u2 0; the differences' low bits (width * 256 / 8 bytes: first the whole
bytes, lowest first, 256 each, then the bits that are left, packed); exceptions: u1 place each, padded to even, u4 difference each. All little-endian.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from stockweave.functions.runtime import new_path
from stockweave.llm import tokens

BLOCK, PERCENT, CHUNK = 256, 90, 1 << 16
HEAD = np.dtype([("least", "<u4"), ("width", "u1"), ("_a", "u1"), ("n", "<u2"), ("n_exc", "<u2"), ("_b", "<u2")])
CHUNK_COLUMNS = "shard int, chunk int, local_start long, n_ids long, doc_lengths array<long>, payload binary, index binary"


def encode_blocks(ids: np.ndarray, percent: int = PERCENT) -> tuple[bytes, np.ndarray]:
    """Payload and block starts (u4) of the ids of a chunk."""
    n = len(ids)
    if not n:
        return b"", np.zeros(0, np.uint32)
    blocks = -(-n // BLOCK)
    grid = np.empty(blocks * BLOCK, np.uint32)
    grid[:n] = ids
    grid[n:] = ids[-1]  # the last block is filled up with an id that it has
    grid = grid.reshape(blocks, BLOCK)
    least = grid.min(axis=1)
    grid -= least[:, None]
    k = -(-BLOCK * percent // 100) - 1
    at = np.partition(grid, k, axis=1)[:, k]
    width = np.where(at > 0, np.frexp(at.astype(np.float64))[1], 0).astype(np.uint8)
    over = grid > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    n_exc = over.sum(axis=1)
    body = HEAD.itemsize + width.astype(np.int64) * (BLOCK // 8)
    sizes = body + n_exc + n_exc % 2 + 4 * n_exc
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    head = np.zeros(blocks, HEAD)
    head["least"], head["width"], head["n"], head["n_exc"] = least, width, np.minimum(BLOCK, n - np.arange(blocks) * BLOCK), n_exc
    out[starts[:, None] + np.arange(HEAD.itemsize)] = head.view(np.uint8).reshape(blocks, -1)
    planes = [(grid >> np.uint32(8 * i)).astype(np.uint8) for i in range(-(-int(width.max()) // 8))]
    for w in np.unique(width).tolist():  # at most 33 widths
        rows = np.nonzero(width == w)[0]
        parts = [planes[i][rows] for i in range(w // 8)]
        if w % 8:
            bits = np.unpackbits(planes[w // 8][rows].reshape(len(rows), BLOCK, 1), axis=2, bitorder="little")[:, :, :w % 8]
            parts.append(np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little"))
        if parts:
            packed = np.concatenate(parts, axis=1)
            out[starts[rows][:, None] + HEAD.itemsize + np.arange(packed.shape[1])] = packed
    block, place, where, values = _exceptions(starts + body, n_exc, over)
    out[where] = place
    out[values[:, None] + np.arange(4)] = grid[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), starts.astype(np.uint32)


def _exceptions(lists: np.ndarray, n_exc: np.ndarray, over: np.ndarray | None = None):
    """Block, place (if known), and the bytes of the place and the difference of each exception; ``lists`` is where a block's list begins."""
    block = np.repeat(np.arange(len(n_exc)), n_exc)
    number = np.arange(len(block)) - np.repeat(np.cumsum(n_exc) - n_exc, n_exc)
    values = lists[block] + (n_exc + n_exc % 2)[block] + 4 * number
    return block, None if over is None else np.nonzero(over)[1], lists[block] + number, values


def decode_blocks(payload: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start there."""
    data, starts = np.frombuffer(payload, np.uint8), starts.astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.uint32)
    head = data[starts[:, None] + np.arange(HEAD.itemsize)].copy().view(HEAD).reshape(-1)
    width = head["width"]
    planes = np.zeros((-(-int(width.max()) // 8), len(starts), BLOCK), np.uint8)
    for w in np.unique(width).tolist():
        rows = np.nonzero(width == w)[0]
        packed = data[starts[rows][:, None] + HEAD.itemsize + np.arange(w * (BLOCK // 8))]
        for i in range(w // 8):
            planes[i][rows] = packed[:, i * BLOCK:(i + 1) * BLOCK]
        if w % 8:
            bits = np.zeros((len(rows), BLOCK, 8), np.uint8)
            bits[:, :, :w % 8] = np.unpackbits(packed[:, w // 8 * BLOCK:], axis=1, bitorder="little").reshape(len(rows), BLOCK, w % 8)
            planes[w // 8][rows] = np.packbits(bits, axis=2, bitorder="little")[:, :, 0]
    grid = np.zeros((len(starts), BLOCK), np.uint32)
    for i, plane in enumerate(planes):
        grid |= plane.astype(np.uint32) << np.uint32(8 * i)
    n_exc = head["n_exc"].astype(np.int64)
    block, _, where, values = _exceptions(starts + HEAD.itemsize + width.astype(np.int64) * (BLOCK // 8), n_exc)
    grid[block, data[where]] = data[values[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    grid += head["least"][:, None]
    return grid.reshape(-1)[(np.arange(BLOCK) < head["n"][:, None]).reshape(-1)]


def _chunks(batches, vocabulary: str, end: int, percent: int):
    """Chunks of a range of documents; a chunk ends with a document, once it has CHUNK ids."""
    from pyspark import TaskContext

    shard, chunk, local, coder = TaskContext.get().partitionId(), 0, 0, tokens.encoder(vocabulary)
    ids: list[np.ndarray] = []
    lengths: list[int] = []
    docs: list[pa.Array] = []
    held, schema = 0, None

    def flush():
        nonlocal ids, lengths, docs, held, chunk, local
        payload, starts = encode_blocks(np.concatenate(ids), percent)
        doc_ids = pa.concat_arrays(docs)
        row = pa.RecordBatch.from_arrays([
            pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids), pa.array([shard], pa.int32()), pa.array([chunk], pa.int32()), pa.array([local], pa.int64()),
            pa.array([held], pa.int64()), pa.array([lengths], pa.list_(pa.int64())), pa.array([payload], pa.binary()), pa.array([starts.astype("<u4").tobytes()], pa.binary())],
            ["doc_ids", *[c.split()[0] for c in CHUNK_COLUMNS.split(", ")]])
        chunk, local = chunk + 1, local + held
        ids, lengths, docs, held = [], [], [], 0
        return row

    for batch in batches:
        for lo, _, texts in tokens.runs(batch.column("text")):
            flat, counts = coder.encode(texts)
            full, ends = tokens.with_end(flat, counts, end)
            own = counts + 1
            first = 0
            for last in np.unique(np.searchsorted(ends, np.arange(CHUNK - held, ends[-1] + 1, CHUNK))).tolist() + [None]:
                stop = len(own) if last is None else last + 1
                if stop > first:
                    a, b = int(ends[first] - own[first]), int(ends[stop - 1])
                    ids.append(full[a:b])
                    lengths += own[first:stop].tolist()
                    docs.append(batch.column("doc_id").slice(lo + first, stop - first))
                    held += b - a
                    first = stop
                if last is not None and held:
                    yield flush()
    if held:
        yield flush()


def write(docs: DataFrame, path: str, end: int = 0, vocabulary: str = tokens.VOCABULARY, percent: int = PERCENT) -> None:
    """Write the ids of every whole text of ``docs`` (doc_id, text; other columns are ignored) in ascending doc_id order, each document with its end id.

    A null or empty text is its end id alone. Rows with the same id stand in the order of a hash of their texts; a null id comes first. The texts are shuffled
    once, by ranges of (doc_id, hash), so no id is bound to one task by its number of rows. A chunk is one row and holds one document at least.
    """
    kind = dict(docs.dtypes)["doc_id"]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = docs.select("doc_id", "text").repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt.mapInArrow(lambda b: _chunks(b, vocabulary, end, percent), f"doc_ids array<{kind}>, {CHUNK_COLUMNS}").write.parquet(path)


def _documents(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            get = lambda name: batch.column(name)[row]  # noqa: B023,E731
            ids = decode_blocks(get("payload").as_py(), np.frombuffer(get("index").as_py(), "<u4"))
            lengths = np.asarray(get("doc_lengths").values, np.int64)
            ends = np.cumsum(lengths)
            crc = [tokens.crc32(ids[b - n:b]) for b, n in zip(ends.tolist(), lengths.tolist())]
            yield pa.RecordBatch.from_arrays([get("doc_ids").values, pa.array(get("base").as_py() + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                                             ["doc_id", "start", "n_tokens", "ids_crc32"])


def located(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of a written table with ``base``, the number of ids before them in the corpus."""
    chunks = spark.read.parquet(path)
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    # one row for each shard: as many as the writing job had tasks
    before = F.sum("_n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    shards = shards.select("shard", F.coalesce(before, F.lit(0)).alias("_before"))
    return chunks.join(F.broadcast(shards), "shard").withColumn("base", F.col("_before") + F.col("local_start"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold of each document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    rows = located(spark, path).select("doc_ids", "doc_lengths", "payload", "index", "base")
    kind = dict(rows.dtypes)["doc_ids"][6:-1]
    return rows.mapInArrow(_documents, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, end: int = 0, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """Write ``docs`` to a new folder in the shared folder and read the files back."""
    path = new_path(docs.sparkSession, "tokens")
    write(docs, path, end, vocabulary)
    return read(docs.sparkSession, path)
