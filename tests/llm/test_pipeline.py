"""The stages of the corpus pipeline, each beside its operator's effect on the stage's own input."""

import corpus_pipeline
from stockweave.functions.runtime import materialize
from stockweave.llm import packing
from tests.llm.test_operators import empty, odd, plain_spans  # noqa: F401
from tests.llm.test_rotation_sketch_survival import plain_components

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF), name)
        seen[name] = (before.collect(), docs.collect())
        if name != "best_fit_packing":
            assert docs.columns == columns
    given, good = seen["quality_classifier"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r["doc_id"] for r in good}
    assert sum(labels.get(r["doc_id"]) == 0 and r["doc_id"] in ids for r in given) <= 1
    assert all(r["doc_id"] in ids for r in given if labels.get(r["doc_id"]) == 1)
    _, single = seen["near_duplicates"]
    assert {c for *_, c, _ in plain_components([(r["doc_id"], r["text"]) for r in good], 80)} == {r["doc_id"] for r in single}
    _, masked = seen["secret_scan"]
    assert len(masked) == len(single) and not any(plain_spans(r["text"]) for r in masked)
    _, mixed = seen["source_mixing"]
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in masked} and len(mixed) > len(masked)
    _, packed = seen["best_fit_packing"]
    assert len({(r["doc_id"]) for r in packed}) == len({r["doc_id"] for r in mixed})
    assert sum(r["piece"] == 0 for r in packed) == len(mixed)
    assert len({r["sequence_id"] for r in packed}) >= packing.bound({n: sum(r["length"] == n for r in packed) for n in {r["length"] for r in packed}}, 1024)


def test_run_equals_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_stages_take_odd_and_empty_tables(spark, odd, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns; then no rows at all."""
    sf = str(tmp_path)
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    for docs in (odd, empty(spark)):
        columns, docs = docs.columns, materialize(docs, "given")
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, materialize(stage(spark, docs, sf), name)
            if name != "best_fit_packing":
                assert docs.columns == columns
                assert docs.select("doc_id").distinct().join(before, "doc_id", "left_anti").filter("doc_id IS NOT NULL").isEmpty()
            assert before.count() == 0 or name == "quality_classifier" or docs.count() > 0
            if before.count() == 0:
                assert docs.count() == 0
