"""Exact top-k search by MaxScore over integer vectors.

A vector's components are its terms. Against a query, the contribution of a term is moved up by the least it can be in a shard, so that every
contribution is zero or more and has an upper bound. Terms are ordered by bound; those that can't lift a vector to the
current k-th score by themselves are non-essential. The postings of the essential terms are traversed for the whole shard; only vectors whose partial score
plus the bounds of what is left reaches the k-th score are probed in the other terms, one term after the other.

Vectors are held in blocks of rows (shards), queries in blocks too. Each pair of blocks is one cell of a grid; the blocks travel as single rows, so
the shuffle moves every vector once for each block of queries. The shards' results are merged by rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stockweave.functions.runtime import materialize

SHARD, QUERIES = 8192, 2048
BATCH = 256  # queries whose first terms are traversed together


def quantized(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and terms (array<bigint>, floor of ``scale`` times each component); vectors that are null or hold a null or a non-finite
    component take no part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.filter(F.coalesce(F.col("embedding").isNotNull() & fine, F.lit(False))).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("terms"))


def _matrix(terms: pa.Array) -> np.ndarray:
    """Rows of terms; shorter vectors count as zero beyond their end."""
    sizes = np.diff(terms.offsets.to_numpy())
    values = terms.values.to_numpy(zero_copy_only=False)[terms.offsets[0].as_py():terms.offsets[-1].as_py()]
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def _blocks(batches, rows: int):
    """One row for each block: the ids and the matrix as bytes."""
    from pyspark import TaskContext

    task, number, ids, terms, held = TaskContext.get().partitionId(), 0, [], [], 0
    names = ["block", "ids", "dims", "matrix"]

    def flush():
        nonlocal ids, terms, held, number
        m = _matrix(pa.concat_arrays(terms))
        out = pa.RecordBatch.from_arrays([pa.array([(task << 32) + number], pa.int64()), pa.array([np.concatenate(ids).tobytes()], pa.binary()),
                                          pa.array([m.shape[1]], pa.int32()), pa.array([m.tobytes()], pa.binary())], names)
        ids, terms, held, number = [], [], 0, number + 1
        return out

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows - held, batch.num_rows - at)
            part = batch.slice(at, n)
            ids.append(part.column("vec_id").to_numpy().astype(np.int64))
            terms.append(part.column("terms"))
            held, at = held + n, at + n
            if held == rows:
                yield flush()
    if held:
        yield flush()


def search(queries: np.ndarray, query_ids: np.ndarray, shard: np.ndarray, shard_ids: np.ndarray, k: int):
    """For each query the best ``k`` of the shard, its own id excepted: (query_id, vec_id, score) arrays."""
    dims = max(queries.shape[1], shard.shape[1])
    wide = lambda m: np.pad(m, ((0, 0), (0, dims - m.shape[1])))
    queries, shard = wide(queries), wide(shard)
    order = np.argsort(shard_ids, kind="stable")  # ascending ids: of equal scores the first wins
    ids, columns = shard_ids[order], np.ascontiguousarray(shard[order].T)
    if not dims or not len(ids):
        columns = np.zeros((1, len(ids)), np.int64)
        queries = np.zeros((len(queries), 1), np.int64)
    top, low = columns.max(axis=1, initial=0), columns.min(axis=1, initial=0)
    # float64 holds the scores exactly below 2**53; beyond that integers are used
    exact = float(np.abs(queries).max(initial=0)) * float(np.abs(columns).max(initial=0)) * max(dims, 1) < 2 ** 52
    matrix = columns.astype(np.float64) if exact else columns.astype(object)
    out = []
    queries = queries.astype(matrix.dtype)
    ends = np.stack([queries * low, queries * top])
    least = ends.min(axis=0)  # of each term's contribution in this shard
    bound = ends.max(axis=0) - least
    order = np.argsort(-bound, axis=1, kind="stable")
    # the first terms of a query are traversed for all vectors; a threshold comes from the exact scores of the best partial sums
    lead = max(1, len(columns) // 2)
    leading = np.zeros(queries.shape, bool)
    np.put_along_axis(leading, order[:, :lead], True, axis=1)
    for i, (q, own) in enumerate(zip(queries, query_ids)):
        if i % BATCH == 0:
            part = slice(i, i + BATCH)
            sums = np.where(leading[part], queries[part], 0) @ matrix - np.where(leading[part], least[part], 0).sum(axis=1)[:, None]
        partial, terms, under = sums[i % BATCH], order[i], least[i]
        tail = np.concatenate([np.cumsum(bound[i][terms][::-1])[::-1], [0]])  # what the terms from here on can add
        shift = under.sum()
        others = ids != own
        partial[~others] = -1
        want = min(k, int(others.sum()))
        if not want:
            continue
        probe = np.argpartition(-partial, min(len(partial) - 1, 4 * want))[:4 * want]
        probe = probe[others[probe]]
        scores = q @ matrix[:, probe] - shift
        floor = np.sort(scores)[-want] if len(scores) >= want else 0
        essential = int(np.searchsorted(-tail, -floor, side="right"))  # terms from here on can't reach the threshold alone
        at = lead
        for t in terms[at:essential]:
            partial += np.where(partial >= 0, q[t] * matrix[t] - under[t], 0)
            at += 1
        alive = np.nonzero((partial >= 0) & (partial + tail[at] >= floor))[0]
        partial = partial[alive]
        for j, t in enumerate(terms[at:], at):
            partial = partial + q[t] * matrix[t, alive] - under[t]
            still = partial + tail[j + 1] >= floor
            if not still.all():
                alive, partial = alive[still], partial[still]
        best = np.lexsort((ids[alive], -partial))[:want]
        out.append((np.full(len(best), own), ids[alive[best]], (partial[best] + shift).astype(np.int64)))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def _cell(query_table: pa.Table, shard_table: pa.Table, k: int) -> pa.Table:
    found = []
    for q in query_table.to_pylist():
        qi = np.frombuffer(q["ids"], np.int64)
        qm = np.frombuffer(q["matrix"], np.int64).reshape(len(qi), q["dims"])
        for s in shard_table.to_pylist():
            si = np.frombuffer(s["ids"], np.int64)
            found.append(search(qm, qi, np.frombuffer(s["matrix"], np.int64).reshape(len(si), s["dims"]), si, k))
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, shard: int = SHARD, queries: int = QUERIES) -> DataFrame:
    """The best ``k`` vectors for each row of ``vectors`` (vec_id, embedding; other columns are ignored) that ``is_query`` picks: query_id, rank
    (from 1), vec_id, score (integer inner product). Ties go to the smaller vec_id.

    A query is compared with every row but those of its own id. Vectors that are null or hold a null or non-finite component, and rows without an id, take no
    part; an empty vector scores zero; vectors of other lengths count as zero beyond their end. A repeated row can take several
    ranks, a repeated query is answered once. An empty table gives no rows.
    """
    terms = quantized(vectors, scale).filter("vec_id is not null")
    kept = "block long, ids binary, dims int, matrix binary"
    n = lambda rows, most: max(1, -(-rows // most))
    asked = materialize(terms.filter(is_query).dropDuplicates(["vec_id"]), "queries")
    held = materialize(terms, "vectors")
    n_rows, n_queries = held.count(), asked.count()
    deal = lambda df, parts: df.repartition(parts, F.xxhash64("vec_id", F.monotonically_increasing_id()))
    shards = materialize(deal(held, n(n_rows, shard)).mapInArrow(lambda b: _blocks(b, shard), kept), "shards")
    asks = materialize(deal(asked, n(n_queries, queries)).mapInArrow(lambda b: _blocks(b, queries), kept), "asks")
    # one row for each block; each goes to all cells of its row or column of the grid
    shards, asks = numbered(shards), numbered(asks)
    across, down = asks.count(), shards.count()
    left = asks.withColumn("_q", F.col("_at")).withColumn("_s", F.explode(F.sequence(F.lit(1), F.lit(max(down, 1)))))
    right = shards.withColumn("_s", F.col("_at")).withColumn("_q", F.explode(F.sequence(F.lit(1), F.lit(max(across, 1)))))
    found = left.groupBy("_q", "_s").cogroup(right.groupBy("_q", "_s")).applyInArrow(lambda a, b: _cell(a, b, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def numbered(blocks: DataFrame) -> DataFrame:
    """Blocks with a number from 1; only their keys are ordered, one for each some thousand rows."""
    numbers = blocks.select("block", F.row_number().over(W.orderBy("block")).alias("_at"))
    return materialize(blocks.join(numbers, "block"), "blocks")
