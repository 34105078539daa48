"""Stages that must not lose rows or items on degenerate tables."""

import random

import pytest

import corpus_pipeline

from framelake.llm.op1_quality import accepted, fit, fitted
from framelake.llm.op4_decontamination import decontaminated, leaks

from .conftest import odd_documents, words


def test_items_without_an_id_are_searched(spark):
    r = random.Random(12)
    items = [words(r, 30) for _ in range(3)]
    bench = spark.createDataFrame([(None, items[0]), (None, items[1]), (5, items[2]), (None, None), (None, "")], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"{words(r, 20)} {t} {words(r, 20)}") for k, t in enumerate([*items, "", f"{items[0]} {items[1]}"])], "doc_id long, text string")
    found = leaks(docs, bench).collect()
    assert sorted(((f.doc_id, f.item_id) for f in found), key=str) == sorted([(0, None), (1, None), (2, 5), (4, None), (4, None)], key=str)
    assert [d.doc_id for d in decontaminated(docs, bench).collect()] == [3]


@pytest.mark.parametrize("labels", [[], [(k, 1, 0) for k in range(20, 40)], [(k, 0, 0) for k in range(20, 40)]])
def test_quality_keeps_all_rows_without_a_model(spark, odd, labels):
    model = fit(odd, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert not fitted(model)
    kept = accepted(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(odd_documents())


@pytest.mark.parametrize("kind", ["odd", "none", "clashing"])
def test_pipeline_stages_on_odd_tables(spark, request, kind):
    docs = request.getfixturevalue(kind)
    d = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d).cache()
        kept = [tuple(r) for r in out.collect()]
        if name == "sharding":
            assert len(kept) == docs.count()  # the last stage places every row
        else:
            assert out.columns == docs.columns
            left = [tuple(r) for r in docs.collect()]
            for row in kept:  # whole rows of the input, none more often than there
                left.remove(row)
        if kind == "none":
            assert not kept
