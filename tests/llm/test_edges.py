"""Every query over empty tables and over awkward rows."""

import zlib

import pytest

import corpus_pipeline
from corpuscope.llm.queries import QUERIES

from .conftest import ROWS

BY_DOCUMENT = [k for k in QUERIES if k.split("_")[0] in ("op1", "op2", "op3", "op4", "op5", "op6", "op7", "op11", "op12")]


@pytest.mark.parametrize("key", [*QUERIES, "pipeline"])
def test_empty_tables_give_empty_results(spark, empty, key):
    rows = corpus_pipeline.PIPELINE_QUERIES[key](spark, empty).collect()
    assert len(rows) == (1 if key.startswith("op8") else 0)  # op8 adds a conversation of its own


@pytest.mark.parametrize("key", BY_DOCUMENT)
def test_one_row_per_document(spark, odd, key):
    rows = QUERIES[key](spark, odd).collect()
    ids = lambda rows: sorted((r[0] is None, r[0] or 0) for r in rows)
    assert ids([(r["doc_id"],) for r in rows]) == ids(ROWS)
    names = rows[0].asDict()
    if "held_out" in names:
        for r in rows:
            assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_language_of_texts_without_letters(spark, odd):
    found = {r["doc_id"]: r for r in QUERIES["op2_language"](spark, odd).collect()}
    for i in (3, 4, 5, 6):
        assert (found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0)
    assert found[10]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_toxicity_scores_every_text(spark, odd):
    for r in QUERIES["op4_toxicity"](spark, odd).collect():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_copies_and_rows_without_words(spark, odd):
    rows = QUERIES["op3_minhash"](spark, odd).collect()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["class_id"] == by[2]["class_id"] == 1 and by[1]["kept"] and not by[2]["kept"]
    assert by[8]["class_id"] == 7
    for i in (3, 4, 5):
        assert by[i]["class_id"] == i and by[i]["kept"]
    assert by[None]["class_id"] is None and by[None]["kept"]


def test_pipeline_stages_keep_columns_and_clean_documents(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, before, odd)
        assert docs.columns == before.columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        before = docs
    ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert ids.count(1) == 1 and 2 not in ids and not {3, 4, 5, 6, 10, 11} & set(ids)
    assert {100 + i for i in range(40)} <= set(ids)
    whole = corpus_pipeline.run(spark, odd).select("doc_id").distinct().collect()
    assert sorted(str(r[0]) for r in whole) == sorted({str(i) for i in ids})
