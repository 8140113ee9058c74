"""How filters interact: truth-table words and positional popcounts.

A document fails some of at most five filters. Its word has one bit for each subset of the filters, set if the document survives all filters of the
subset; bit 0 (no filter) is always set. How many documents of a part survive each subset is the positional popcount of the part's words: for each of the 32
places, the number of words with that bit. It is taken by carry-save adders: three words give a word of sums and a word of carries, the carries meet
again at twice the weight, and what is left after the last turn is read bit by bit.

Everything an audit asks for follows from these 32 numbers of each part and label, whatever the order of the filters: a step removes what survives the filters before
it less what survives those with it. The documents are counted once, in partial sums of 32 numbers for each task and part.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stockweave.functions.runtime import materialize

FILTERS = "ABCDE"
#: Fixed: failing A is under 200 words; B 100 * distinct < 50 * words; C 100 * capitals > 3 * code points; D any of these marks; E a copy.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 3, b"#$%&*|"
_CAPITALS, _INNER = bytes(range(ord("A"), ord("Z") + 1)), bytes(range(0x80, 0xC0))


def failures(text: bytes) -> int:
    """Bit k is set if the text fails filter k of A to D."""
    words = text.split()  # of bytes: at the six ASCII white-space characters only
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _INNER))
    return ((len(words) < LEAST_WORDS) | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
            | (100 * capitals > MOST_CAPITALS * points) << 2 | (len(text.translate(None, MARKS)) < len(text)) << 3)


def survival_words(filters: int) -> np.ndarray:
    """The word of every set of failures: bit S is set if none of the failures is in the subset S."""
    subsets = np.arange(1 << filters)
    return np.array([(1 << subsets[(subsets & f) == 0].astype(np.uint64)).sum(dtype=np.uint64) for f in subsets], np.uint64).astype(np.uint32)


def positional_counts(words: np.ndarray, places: int = 32) -> np.ndarray:
    """For each place the number of ``words`` with that bit, by carry-save adders."""
    counts, weight, level = np.zeros(places, np.int64), 1, words
    while len(level):
        carries = []
        while len(level) > 2:
            k = len(level) // 3
            a, b, c = level[:k], level[k:2 * k], level[2 * k:3 * k]
            half = a ^ b
            carries.append((a & b) | (half & c))
            level = np.concatenate([half ^ c, level[3 * k:]])
        for word in level.tolist():
            counts += weight * ((word >> np.arange(places)) & 1)
        level = np.concatenate(carries) if carries else level[:0]
        weight *= 2
    return counts


def failed(docs: DataFrame, part: str = "lang") -> DataFrame:
    """Per row of ``docs`` (doc_id, text and ``part``): doc_id, part (null: empty), fails (bits of A to D), copy_key (of the whole text)."""
    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(map(failures, texts), pa.int32()),
                                              pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], ["doc_id", "part", "fails", "copy_key"])

    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, part string, fails int, copy_key binary")


def survivors(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, kind, alive): for each part and kind (all, good, toxic) how many documents survive each subset of the filters, at place S of the array for the
    subset with bits S.

    The join that marks copies has one row for each text that occurs twice or more on its small side, and adaptive execution splits a text with a third of all
    rows. Labels are one row for each id; rows without an id never meet them.
    """
    rows = materialize(failed(docs, part), "failures")
    first = rows.groupBy("copy_key").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).filter("_first < _last")
    marked = rows.join(materialize(first.select("copy_key", "_first"), "copies"), "copy_key", "left")
    fails = F.col("fails") + F.when(F.col("doc_id") > F.col("_first"), 16).otherwise(0)
    marked = materialize(marked.select("doc_id", "part", fails.alias("fails")), "marked")
    has = lambda c: F.coalesce(F.max(F.when(F.col(c) == 1, True)), F.lit(False)).alias(f"_{c}")
    said = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(has("quality"), has("toxic"))
    no = F.lit(False)
    known = marked.filter("doc_id IS NOT NULL").join(said, "doc_id", "left").select("part", "fails", F.coalesce("_quality", no).alias("good"), F.coalesce("_toxic", no).alias("toxic"))
    unknown = marked.filter("doc_id IS NULL").select("part", "fails", no.alias("good"), no.alias("toxic"))

    def run(batches):
        table = survival_words(len(FILTERS))
        for batch in batches:
            if not batch.num_rows:
                continue
            words = table[batch.column("fails").to_numpy()]
            parts = batch.column("part").dictionary_encode()
            code = parts.indices.to_numpy().astype(np.int64)
            kinds = {"all": None, **{k: np.asarray(batch.column(k).to_numpy(zero_copy_only=False), bool) for k in ("good", "toxic")}}
            order = np.argsort(code, kind="stable")
            names, out = parts.dictionary.to_pylist(), []
            for own in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                for kind, of in kinds.items():
                    out.append((names[code[own[0]]], kind, positional_counts(words[own if of is None else own[of[own]]]).tolist()))
            name, kind, alive = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(kind), pa.array(alive, pa.list_(pa.int64()))], ["part", "kind", "alive"])

    counted = known.unionByName(unknown).mapInArrow(run, "part string, kind string, alive array<bigint>")
    return counted.groupBy("part", "kind").agg(F.array(*[F.sum(F.col("alive")[s]) for s in range(1 << len(FILTERS))]).alias("alive"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """For each part of ``docs`` (doc_id, text and ``part``; other columns are ignored), each order of the filters and each step: what its filter does there
    (kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley; see the contract of op13).

    A null text is empty: it fails A alone. A null part is the empty string. E fails where a row with a smaller doc_id has the same text; rows of the same id are
    no copies of each other, and a null id is neither a copy nor what others are copies of. A document with several label rows counts as good
    or toxic if one of them says so. An empty table has no parts and gives no rows.
    """
    alive = materialize(survivors(docs, labels, part).groupBy("part").agg(*[F.max(F.when(F.col("kind") == k, F.col("alive"))).alias(k) for k in ("all", "good", "toxic")]), "survivors")
    orders = list(permutations(range(len(FILTERS))))
    steps = [(o, i) for o in orders for i in range(len(FILTERS))]
    before = [sum(1 << f for f in o[:i]) for o, i in steps]
    own = [1 << o[i] for o, i in steps]
    every, none = (1 << len(FILTERS)) - 1, F.lit(0)
    at = lambda xs, kind="int": F.split(F.lit(",".join(map(str, xs))), ",").cast(f"array<{kind}>")[F.col("_at")]
    rows = alive.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1)))).select(
        "part", "all", "good", "toxic", at(["".join(FILTERS[f] for f in o) for o, _ in steps], "string").alias("filter_order"), at([i + 1 for _, i in steps]).alias("step"),
        at(before).alias("_b"), at(own).alias("_f"))
    lost = lambda kind: F.get(kind, F.col("_b")) - F.get(kind, F.col("_b") + F.col("_f"))
    removed = rows.select("*", lost("all").alias("removed"))
    worth = F.lit(0).cast("bigint")  # over all orders: a subset before the filter, as often as it can be ordered with what follows
    for s in range(every + 1):
        times = sum(b == s for b in before)  # steps at which the subset stands before a filter
        left = len(FILTERS) - s.bit_count()
        if left:
            outside = F.when(F.lit(s).bitwiseAND(F.col("_f")) == 0, F.col("all")[s] - F.get("all", F.lit(s).bitwiseOR(F.col("_f")))).otherwise(none)
            worth = worth + outside * (times // left)
    return removed.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), F.get("all", F.col("_b") + F.col("_f")).alias("kept"), "removed",
        (F.col("all")[0] - F.get("all", "_f") - F.col("removed")).alias("redundant"), (F.get("all", F.lit(every) - F.col("_f")) - F.col("all")[every]).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), worth.alias("shapley"))
