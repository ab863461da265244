"""Toxicity with very few toxic training rows: the trees are kept."""

import zlib

import pytest

from siftguard.llm.toxicity import score_toxicity


@pytest.mark.parametrize("toxic", [1, 3, 4])
def test_few_toxic_rows(spark, toxic):
    learnt = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 != 2]
    bad = set(learnt[:: len(learnt) // toxic][:toxic])
    text = lambda i: "YOU ARE ALL WRONG!!! YOU!!! " * 8 if i in bad else f"calm words about number {i} and other things " * 6
    docs = spark.createDataFrame([(i, text(i)) for i in range(600)] + [(9000, text(min(bad)))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in bad)) for i in range(600)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in score_toxicity(docs, labels).collect()}
    clean = [s for i, s in got.items() if i not in bad and i != 9000]
    assert len(got) == 601 and len(set(got.values())) > 1
    assert min(got[i] for i in bad) > max(clean) and got[9000] > max(clean)


def test_one_class_only(spark):
    docs = spark.createDataFrame([(i, "some text") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int")
    assert {r["score"] for r in score_toxicity(docs, labels).collect()} == {0.0}
