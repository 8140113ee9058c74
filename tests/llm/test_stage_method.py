"""The near-duplicate stage goes through SimHash's blocks, and loses no link to them."""

import random

import corpus_pipeline
from stockweave.llm import setsketch, simhash
from tests.llm.test_operators import docs_of
from tests.llm.test_rotation_sketch_survival import plain_components


def given(spark):
    """Texts of 300 words and copies with 1, 3 and 6 words changed, one after the other."""
    rng, texts = random.Random(5), []
    for _ in range(12):
        words = [f"w{rng.randrange(4000)}" for _ in range(300)]
        for changed in (0, 0, 1, 3, 6):
            for at in rng.sample(range(300), changed):
                words[at] = f"x{rng.randrange(10 ** 6)}"
            texts.append(" ".join(words))
    return [(i, t, "en", "a") for i, t in enumerate(texts)], docs_of(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])


def test_the_stage_asks_the_blocks_first_and_keeps_every_link(spark, monkeypatch):
    texts, docs = given(spark)
    asked, candidates = [], simhash.candidates

    def told(sets, near=2):
        pairs = candidates(sets, near)
        asked.append(pairs.count())
        return pairs

    monkeypatch.setattr(simhash, "candidates", told)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, None).collect()}
    assert len(asked) == 1 and asked[0] > 0
    assert kept == {c for *_, c, _ in plain_components([(i, t) for i, t, *_ in texts], 80)}


def test_candidates_tie_all_prints_within_two_bits(spark):
    rng = random.Random(9)
    prints = [rng.getrandbits(64) for _ in range(30)]
    prints += [p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in prints] + prints[:5]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    sets = spark.createDataFrame(list(enumerate(signed)), "fp bigint, print bigint")
    root = list(range(len(prints)))
    for r in sorted(simhash.candidates(sets).collect()):
        low, high = sorted((root[r["a"]], root[r["b"]]))
        root = [low if x == high else x for x in root]
    assert all((root[i] == root[j]) == (i % 30 == j % 30) for i in range(65) for j in range(65))
    assert setsketch.sketches(docs_of(spark, [(1, None, "en", "a"), (2, "a b", "en", "a")]), prints=True).filter("print = 0").count() == 1
