"""Quality classifier: neighbours in a latent-semantic space vote, weighted by similarity.

A text is a bag of hashed terms: its words, and the shapes of its words (letter case, marks, whether a word repeats the one before). The latent
space comes from a truncated singular value decomposition of a bounded, hash-chosen sample of labelled rows; the sample's vectors and labels, and the projection, are
broadcast (``fit_rows`` x ``dims`` and ``buckets`` x ``dims`` numbers, bounded by parameters). Every document is projected, compared with every labelled vector
in blocks by exact cosine products, and scored by the labels of its nearest ones.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stockweave.llm.common import give_back

WORDS, SHAPES = 4096, 1024  # buckets of hashed words and shapes
CACHED_WORDS = 400_000  # words a worker keeps the buckets of; then it starts anew, which changes no result


@dataclass(frozen=True)
class Fit:
    """Documented bounds and settings. ``fit_rows`` labelled rows at most are used, chosen by a hash of their ids."""

    fit_rows: int = 4096
    dims: int = 48
    neighbours: int = 15
    sharpness: float = 20.0
    shape_weight: float = 3.0
    doubt: float = 0.05  # weight of the labels' mean in a vote


@dataclass(frozen=True)
class Model:
    projection: np.ndarray  # buckets x dims
    vectors: np.ndarray  # labelled rows x dims, unit length
    labels: np.ndarray
    mean: float
    fit: Fit


def shape_of(word: str) -> str:
    """Runs of capitals, small letters, digits and marks, each as one sign; marks stay themselves."""
    s = re.sub(r"[^\W\d_]+", lambda m: "X" if m[0].isupper() and len(m[0]) > 1 else "x", word)
    return re.sub(r"(.)\1+", r"\1\1", re.sub(r"\d+", "9", s))


def buckets(words: list[str], cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of a text's terms and how often each occurs."""
    if len(cache) > CACHED_WORDS:
        cache.clear()
    counts: dict[int, int] = {}
    for word, n in Counter(words).items():
        both = cache.get(word)
        if both is None:
            plain = word.strip(".,;:!?").lower()
            both = cache[word] = (zlib.crc32(plain.encode("utf-8", "surrogatepass")) % WORDS, WORDS + zlib.crc32(shape_of(word).encode("utf-8", "surrogatepass")) % (SHAPES - 1))
        for b in both:
            counts[b] = counts.get(b, 0) + n
    again = sum(map(str.__eq__, words, words[1:]))
    if again:
        counts[WORDS + SHAPES - 1] = again
    return np.fromiter(counts.keys(), np.int64, len(counts)), np.fromiter(counts.values(), np.float64, len(counts))


def bags(texts: list[str | None], shape_weight: float, cache: dict) -> np.ndarray:
    """One row for each text: words by the root of their share, shapes by their share; both parts of unit length, shapes times ``shape_weight``."""
    out = np.zeros((len(texts), WORDS + SHAPES), np.float32)
    for i, t in enumerate(texts):
        words = re.findall("[^\x20\x09-\x0D]+", t or "")
        if words:
            at, n = buckets(words, cache)
            out[i, at] = n / len(words)
    np.sqrt(out[:, :WORDS], out=out[:, :WORDS])
    for part, weight in ((out[:, :WORDS], 1.0), (out[:, WORDS:], shape_weight)):
        size = np.linalg.norm(part, axis=1, keepdims=True)
        part *= np.where(size > 0, weight / np.maximum(size, 1e-30), 0)
    return out


def latent(matrix: np.ndarray, dims: int, rounds: int = 3) -> np.ndarray:
    """The ``dims`` leading right singular vectors, by randomised range finding with a fixed start."""
    dims = min(dims, *matrix.shape)
    start = np.random.default_rng(7).standard_normal((matrix.shape[1], min(dims + 16, min(matrix.shape)))).astype(np.float32)
    basis = np.linalg.qr(matrix @ start)[0]
    for _ in range(rounds):
        basis = np.linalg.qr(matrix @ np.linalg.qr(matrix.T @ basis)[0])[0]
    return np.linalg.svd(basis.T @ matrix, full_matrices=False)[2][:dims].T.astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.where(size > 1e-12, rows / np.maximum(size, 1e-12), 0).astype(np.float32)


def _bags(batches, shape_weight: float):
    cache: dict = {}
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            rows = bags(part.column("text").to_pylist(), shape_weight, cache)
            places = [np.nonzero(r)[0] for r in rows]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.string()), part.column("quality"), pa.array([p.astype(np.int32) for p in places], pa.list_(pa.int32())),
                                              pa.array([r[p] for r, p in zip(rows, places)], pa.list_(pa.float32()))], ["id", "quality", "at", "value"])


def held_out(doc_id="doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, quality) marks and that aren't held out.

    Rows without an id or a label teach nothing; of several labels of one id the smallest counts. At most ``fit_rows`` ids are taken, so what comes to the
    driver is bounded: some hundred numbers for each. Without any labelled row every score is one half.
    """
    chosen = (labels.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit.fit_rows))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = rows.mapInArrow(lambda b: _bags(b, fit.shape_weight), "id string, quality int, at array<int>, value array<float>").dropDuplicates(["id"]).toArrow()
    model = _fitted(found.sort_by("id").combine_chunks(), fit)  # rows of one id count once, so the bound holds
    del found
    give_back()
    return model


def _filled(found: pa.Table) -> np.ndarray:
    """The bags of ``found`` (at, value) as rows."""
    matrix = np.zeros((found.num_rows, WORDS + SHAPES), np.float32)
    for i, (at, value) in enumerate(zip(found.column("at"), found.column("value"))):
        matrix[i, at.values.to_numpy()] = value.values.to_numpy()
    return matrix


def _fitted(found: pa.Table, fit: Fit) -> Model:
    """The model of labelled bags (id, quality, at, value). Only one matrix of all of them stands in memory at a time."""
    y = found.column("quality").to_numpy().astype(np.float32)
    if not len(y):
        return Model(np.zeros((WORDS + SHAPES, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5, fit)
    matrix = _filled(found)
    rare = np.log((1 + len(y)) / (1 + np.count_nonzero(matrix, axis=0))).astype(np.float32)
    rare[WORDS:] = 1
    matrix *= rare
    projection = rare[:, None] * latent(matrix, fit.dims)
    del matrix
    return Model(projection, unit(_filled(found) @ projection), y, float(y.mean()), fit)


def scores(texts: list[str | None], model: Model, cache: dict, block: int = 256) -> np.ndarray:
    """Share of label 1 among the nearest labelled vectors, each by its cosine to a power; an empty text gets the labels' mean."""
    out = np.full(len(texts), model.mean)
    if not len(model.labels):
        return out
    k = min(model.fit.neighbours, len(model.labels))
    for lo in range(0, len(texts), block):
        x = unit(bags(texts[lo:lo + block], model.fit.shape_weight, cache) @ model.projection)
        cosine = x @ model.vectors.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** model.fit.sharpness
        votes = (weight * model.labels[near]).sum(axis=1) + model.fit.doubt * model.mean
        out[lo:lo + block] = votes / (weight.sum(axis=1) + model.fit.doubt)
    return np.clip(out, 0, 1)


def score_of(spark: SparkSession, model: Model, text: str = "text") -> Column:
    """The score of a text column, by batches."""
    shared = spark.sparkContext.broadcast(model)
    cache: dict = {}

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(scores(texts.to_pylist(), shared.value, cache), pa.float64())

    return score(F.col(text))


def judge(docs: DataFrame, labels: DataFrame, limit: float = 0.3, fit: Fit = Fit()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, held_out, score, predicted (1 if score >= ``limit``).

    A null or empty text, or one without words, gets the labels' mean. A null id is never held out. Repeated rows get equal scores. An empty table gives
    no rows.
    """
    score = score_of(docs.sparkSession, train(docs, labels, fit))
    return docs.select("doc_id", held_out().alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= limit).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, limit: float = 0.3, fit: Fit = Fit()) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``limit``, with all their columns."""
    score = score_of(docs.sparkSession, train(docs, labels, fit))
    scored = docs.select(F.struct("*").alias("_row"), score.alias("_score"))
    return scored.filter(F.col("_score") >= limit).select("_row.*")
