"""Quality rules with thresholds that follow each language and source.

Fixed cutoffs on ratios (word length, symbols, repeats, ...) are wrong for some language or source. Here each ratio is sketched per
(language, source): a log-bucket quantile sketch, whose value at any quantile is within 1% of the true one. Sketches are
counts by bucket, so they merge by adding: tasks pre-aggregate them, and the sketches of a language and of the whole corpus are sums of the finer
ones. A group's fence is its upper quartile plus ``reach`` times the distance of its quartiles (at least a floor), pulled towards the fence of its language, and that
towards the corpus's, by ``prior`` observations, so that a rare source is judged by its language without a switch. The fences
are then joined to the rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stockweave.functions.runtime import materialize
from stockweave.llm.common import key_of

STEP = math.log(1.02)  # of the sketches' buckets: neighbours differ by 2%
BOTTOM = -100_000  # the bucket of zero
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_marks long, n_upper long"


@dataclass(frozen=True)
class Ratio:
    """``top / bottom``, fenced above (and below if ``both``); ``floor`` is the least distance of the quartiles."""

    name: str
    top: str
    bottom: str
    floor: float
    both: bool = False


RATIOS = (
    Ratio("word_length", "word_chars", "n_words", 0.4, True),
    Ratio("symbols", "n_symbols", "n_words", 0.02),
    Ratio("dup_lines", "n_dup_lines", "n_lines", 0.15),
    Ratio("repeats", "n_repeat_words", "n_words", 0.1),
    Ratio("marks", "n_marks", "word_chars", 0.015),
    Ratio("upper", "n_upper", "word_chars", 0.02),
)


def _classes() -> np.ndarray:
    """By code point below 256: 1 white space, 2 symbol, 4 ASCII punctuation, 8 Latin capital."""
    kinds = np.zeros(256, np.uint8)
    kinds[[32, *range(9, 14)]] |= 1
    kinds[[ord(c) for c in "#*$%&|<>"]] |= 2
    kinds[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] |= 4
    kinds[[*range(65, 91), *range(192, 215), *range(216, 223)]] |= 8
    return kinds


CLASSES = _classes()


def text_features(text: str) -> tuple[int, ...]:
    """The columns of FEATURES for one whole text."""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    triples = list(zip(words, words[1:], words[2:]))
    seen = Counter(triples)
    repeated = 0
    if len(seen) < len(triples):
        upto = 0  # words before this place are counted
        for i, t in enumerate(triples):
            if seen[t] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    lines, dup = set(), 0
    n_lines = 0
    for line in text.split("\n"):
        if line.strip(" \t\r\x0b\x0c"):
            n_lines += 1
            dup += line in lines
            lines.add(line)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = np.bincount(CLASSES[points[points < 256]], minlength=16)
    of = lambda bit: int(sum(n for k, n in enumerate(kinds) if k & bit))
    return len(words), len(points) - of(1), of(2), dup, repeated, n_lines, of(4), of(8)


def _features(batches):
    for batch in batches:
        rows = [text_features(t or "") for t in batch.column("text").to_pylist()]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 8
        keep = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], *columns], [*keep, *[f.split()[0] for f in FEATURES.split(", ")]])


def features(docs: DataFrame) -> DataFrame:
    """doc_id, _key, _lang and the columns of FEATURES, from ``docs`` (doc_id, text, lang, source)."""
    slim = docs.select("doc_id", F.concat_ws("\x01", key_of("lang"), key_of("source")).alias("_key"), key_of("lang").alias("_lang"), "text")
    kind = dict(slim.dtypes)["doc_id"]
    return slim.mapInArrow(_features, f"doc_id {kind}, _key string, _lang string, {FEATURES}")


def base_failed() -> Column:
    """Fixed: fewer than 50 words, or over half of them in repeated windows of three."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratio(r: Ratio) -> Column:
    return F.when(F.col(r.bottom) > 0, F.col(r.top) / F.col(r.bottom)).otherwise(F.lit(0.0))


def bucket(x: Column) -> Column:
    return F.when(x > 0, F.ceil(F.log(x) / STEP)).otherwise(BOTTOM).cast("int")


def sketches(rows: DataFrame, ratios=RATIOS) -> DataFrame:
    """(_key, _lang, ratio, bucket, n): one sketch for each group and ratio."""
    each = F.array(*[F.struct(F.lit(i).alias("ratio"), bucket(ratio(r)).alias("bucket")) for i, r in enumerate(ratios)])
    return rows.select("_key", "_lang", F.explode(each).alias("b")).groupBy("_key", "_lang", "b.ratio", "b.bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """n, q1 and q3 of each sketch; a group's buckets are at most some thousands, whatever its rows."""
    w = W.partitionBy(*keys, "ratio")
    seen = sketch.withColumns({"_upto": F.sum("n").over(w.orderBy("bucket")), "_n": F.sum("n").over(w)})
    value = F.when(F.col("bucket") == BOTTOM, 0.0).otherwise(F.exp(F.col("bucket") * STEP) * (2 / (1 + math.exp(STEP))))
    at = lambda q: F.min(F.when(F.col("_upto") > F.floor((F.col("_n") - 1) * q), value))
    return seen.groupBy(*keys, "ratio").agg(F.max("_n").alias("n"), at(0.25).alias("q1"), at(0.75).alias("q3"))


def fences(rows: DataFrame, ratios=RATIOS, reach: float = 3.0, prior: float = 50.0) -> DataFrame:
    """One row for each group: _key, and the arrays _low and _high with a fence for each ratio."""
    fine = materialize(sketches(rows, ratios), "sketches")
    merged = lambda keys: fine.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
    floor = F.element_at(F.array(*[F.lit(r.floor) for r in ratios]), F.col("ratio") + 1)
    spread = F.greatest(F.col("q3") - F.col("q1"), floor) * reach
    levels = [quartiles(merged(keys), keys).select(*keys, "ratio", F.col("n").alias(f"n{i}"), (F.col("q1") - spread).alias(f"low{i}"), (F.col("q3") + spread).alias(f"high{i}"))
              for i, keys in enumerate(([], ["_lang"], ["_key", "_lang"]))]
    all_levels = levels[2].join(levels[1], ["_lang", "ratio"]).join(levels[0], "ratio")

    def pulled(side: str) -> Column:
        lang = (F.col("n1") * F.col(f"{side}1") + prior * F.col(f"{side}0")) / (F.col("n1") + prior)
        return (F.col("n2") * F.col(f"{side}2") + prior * lang) / (F.col("n2") + prior)

    one = F.struct("ratio", pulled("low").alias("low"), pulled("high").alias("high"))
    return all_levels.groupBy("_key").agg(F.sort_array(F.collect_list(one)).alias("_f")).select(
        "_key", F.col("_f.low").alias("_low"), F.col("_f.high").alias("_high"))


def inside(ratios=RATIOS) -> Column:
    ok = F.lit(True)
    for i, r in enumerate(ratios):
        ok = ok & (ratio(r) <= F.col("_high")[i])
        if r.both:
            ok = ok & (ratio(r) >= F.col("_low")[i])
    return ok


def judge(docs: DataFrame, ratios=RATIOS, reach: float = 3.0, prior: float = 50.0) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang, source; other columns are ignored): doc_id, the counts, base_failed, kept.

    Fences are learnt from the rows that pass the base rules. Null and empty texts have no words and fail; null languages and sources are
    groups of their own; repeated rows each count. A group of which no row passes the base rules has no fences and keeps nothing. An empty table gives
    no rows.
    """
    rows = materialize(features(docs), "features").withColumn("base_failed", base_failed())
    limits = fences(rows.filter(~F.col("base_failed")), ratios, reach, prior)
    return rows.join(limits, "_key", "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside(ratios), F.lit(False))).drop("_key", "_lang", "_low", "_high")
