from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tickflow.llm import decontamination, line_dedup, near_dedup, toxicity
from tickflow.llm.queries import QUERIES, table

SMALL = "/root/testdata/sf0.001"


def test_registered():
    found = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in QUERIES} and set(QUERIES) < set(found)
    assert "pipeline" in found and len(corpus_pipeline.STAGES) == 5


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage, each read from what the one before has written."""
    from tickflow.runtime import written
    docs, out = table(spark, SMALL, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        result = written(stage(spark, docs, SMALL), name.replace(" ", "-"))
        out.append((docs, result))
        docs = result
    return out


def test_columns_pass(stages):
    for docs, result in stages[:-1]:
        assert result.columns == docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_on_its_input(spark, stages):
    docs, kept = stages[0]
    scored = toxicity.toxicity(docs, toxicity.train(docs, table(spark, SMALL, "labels")))
    assert Counter(r[0] for r in kept.collect()) == Counter(r[0] for r in scored.where("not rejected").collect())

    docs, cut = stages[1]
    want = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect() if r["text"] != want.get(None))

    docs, kept = stages[2]
    classes = near_dedup.near_duplicates(docs)
    assert sorted(r[0] for r in kept.collect()) == sorted(r[0] for r in classes.select("class_id").distinct().collect())

    docs, kept = stages[3]
    hit = decontamination.contamination(docs, table(spark, SMALL, "benchmark")).where("size(items) > 0")
    bad = {r["doc_id"] for r in hit.collect()}
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - bad

    docs, packed = stages[4]
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_run_equals_the_stages(spark, stages):
    assert corpus_pipeline.run(spark, SMALL).drop("sequence_id", "offset").exceptAll(
        stages[-1][1].drop("sequence_id", "offset")).count() == 0


def test_nulls_repeats_and_an_empty_table(spark):
    docs = table(spark, SMALL, "documents")
    odd = spark.createDataFrame([(None, "some words here", None, None, None), (None, None, None, None, None),
                                 (10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "b c", "xx", "s", 3),
                                 (10**6 + 2, "b c", "xx", "s", 3)], docs.schema)
    for frame in (docs.limit(20).unionByName(odd), docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, frame, SMALL).collect()
            assert bool(rows) == bool(frame.count()), name
            if frame.count() and name in ("toxicity", "line dedup", "decontamination"):
                assert sum(r["doc_id"] is None for r in rows) == 2
            if frame.count() and name == "near-dedup":
                assert sum(r["doc_id"] is None for r in rows) == 2
                assert Counter(r["doc_id"] for r in rows)[10**6 + 2] == 1
