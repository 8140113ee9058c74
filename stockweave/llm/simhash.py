"""SimHash near-duplicates: pigeonhole blocks, then verified Hamming distance.

A fingerprint is cut into ``near + 6`` blocks. Two fingerprints that differ in at most ``near`` bits agree outside some ``near`` blocks,
so they meet in a bucket keyed by the blocks that are left (for near = 2: 28 keys of 48 bits each). Members of a bucket differ only in the blocks left out, at
most 16 bits for near = 2, so a bucket holds at most 65,536 different fingerprints, however many documents there are. Copies of a fingerprint are
one row before anything is joined. Inside a bucket the distances are verified and the links are reduced to a spanning forest, so
no group is ever expanded into all of its pairs; the components of all buckets are then tied together.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stockweave.functions.runtime import materialize
from stockweave.llm.components import components

SEED, BITS = 42, 64


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64 bits, as a signed integer: a bit is 1 if it is in over half of the hashes of the shingles, repeats included."""
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", text.lower())  # lower() of bytes changes A-Z only
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(p, SEED) for p in parts], ">u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0].astype(np.int64))


def print_of_set(hashes: np.ndarray) -> int:
    """The fingerprint of a set of 64-bit hashes, as a signed integer; zero for the empty set."""
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0].astype(np.int64))


def fp_of(text: str) -> Column:
    """The fingerprint of a text column, by batches."""
    @F.arrow_udf("bigint")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t or b"") for t in texts.to_pylist()], pa.int64())

    return prints(F.col(text).cast("binary"))


def masks(near: int) -> list[int]:
    """For each choice of ``near`` blocks of ``near + 6``: the bits that are kept, as a signed integer."""
    edges = np.linspace(0, BITS, near + 7).round().astype(int)
    blocks = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges, edges[1:])]
    every = (1 << BITS) - 1
    kept = [every ^ sum(out) for out in combinations(blocks, near)]
    return [k - (1 << BITS) if k >> (BITS - 1) else k for k in kept]


def forest(members: np.ndarray, near: int, cells: int = 1 << 22) -> np.ndarray:
    """Smallest member that each of the different ``members`` reaches over links of at most ``near`` bits."""
    n = len(members)
    block = max(1, cells // n)
    bits = members.view(np.uint64)
    pairs = []
    for s in range(0, n, block):  # rows in blocks; only the links are kept
        apart = np.bitwise_count(bits[s:s + block, None] ^ bits[None, s:]) <= near
        i, j = np.nonzero(apart)
        keep = i < j
        pairs.append(np.stack([i[keep] + s, j[keep] + s]))
    return members[smallest(n, *np.concatenate(pairs, axis=1))]


def smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the smallest one that it reaches over links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _forests(batches, near: int):
    for batch in batches:
        left, right = [], []
        for row in batch.column("members"):
            members = np.sort(np.asarray(row.values, np.int64))
            roots = forest(members, near)
            moved = roots != members
            left.append(members[moved])
            right.append(roots[moved])
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left), pa.int64()), pa.array(np.concatenate(right), pa.int64())], ["a", "b"])


def links(prints: DataFrame, near: int = 2) -> DataFrame:
    """A spanning forest of the links between the different fingerprints ``fp`` of ``prints``: a, b."""
    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(near))])
    buckets = (prints.select("fp", F.explode(keys).alias("k")).groupBy("k.i", "k.key").agg(F.collect_list("fp").alias("members"))
               .filter(F.size("members") > 1).select("members"))
    return buckets.mapInArrow(lambda batches: _forests(batches, near), "a bigint, b bigint")


def candidates(sets: DataFrame, near: int = 2) -> DataFrame:
    """Pairs (a, b) of the keys ``fp`` of ``sets`` (fp, print) that tie all sets whose prints are linked: each set with the smallest one of its print, and these along
    the spanning forest of :func:`links`."""
    least = materialize(sets.groupBy(F.col("print").alias("fp")).agg(F.min("fp").alias("least")), "prints")
    own = sets.join(least.withColumnRenamed("fp", "print"), "print").filter("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    end = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_set"))
    across = links(least.select("fp"), near).join(end("a"), "a").join(end("b"), "b")
    return own.unionByName(across.select(F.least("a_set", "b_set").alias("a"), F.greatest("a_set", "b_set").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, near: int = 2) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, fp, component_id (the smallest doc_id that can be reached
    over links of at most ``near`` differing bits, itself included), root (the component itself, as its smallest fingerprint).

    A null or empty text has fingerprint zero and is linked like any other. Copies and repeated rows share a fingerprint. A null id
    takes part, and is the component's id only where no other is. An empty table gives no rows.
    """
    each = materialize(docs.select("doc_id", fp_of("text").alias("fp")), "fingerprints")
    first = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    roots = components(links(first.select("fp"), near))
    tied = first.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = tied.groupBy("root").agg(F.min("first").alias("component_id"))
    return each.join(tied.select("fp", "root").join(ids, "root").select("fp", "component_id", "root"), "fp", "left").select("doc_id", "fp", "component_id", "root")


def one_of_each(docs: DataFrame, groups: DataFrame, print_of) -> DataFrame:
    """The rows of ``docs`` that stay when of each root of ``groups`` (doc_id, fp, root) one row does: one with the smallest
    doc_id, a null id only where no other is. ``print_of`` gives the fp of a text column."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "fp")).alias("m")
    found = groups.groupBy("root").agg(least).select("m.doc_id", "m.fp")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), print_of("text").alias("_fp"))
    same = rows["_id"].eqNullSafe(found["doc_id"]) & (rows["_fp"] == found["fp"])
    first = F.row_number().over(W.partitionBy("_id", "_fp").orderBy(F.xxhash64("_row.text")))
    return rows.join(found, same, "left_semi").withColumn("_n", first).filter("_n = 1").select("_row.*")


def keep_one(docs: DataFrame, near: int = 2) -> DataFrame:
    """The rows of ``docs`` without near-duplicates, with all their columns: of each component one row stays, one with the smallest
    doc_id. An empty table gives no rows."""
    return one_of_each(docs, near_duplicates(docs, near), fp_of)


def as_hex(fp="fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
