"""Stages of the pipeline on rows that repeat ids, have none, or bring columns of their own."""

from collections import Counter
from hashlib import md5

import pytest

import corpus_pipeline
from siftguard.llm.mixing import mix_sources

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row_0 string, copies int, `a.b` int, key string, "
    "token long, size long, host string"
)
STAGES = dict(corpus_pipeline.STAGES)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "r", 7, None, None, 1, 2, "h") for i, t, s in rows], SCHEMA)


def seen(df):
    return Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())


def prose(seed, n=90):
    return " ".join(f"w{(seed * 7919 + k * k * (seed + 3)) % 9973}" for k in range(n))


def test_quality_rules_judge_rows(spark, sf_dir):
    bad = "spam spam spam " * 40
    rows = [(i, prose(i), "good.org") for i in range(30)] + [(100 + i, bad, "bad.org") for i in range(30)]
    rows += [(5, prose(5), "bad.org"), (5, "short", "good.org"), (None, prose(40), "good.org"), (None, bad, "good.org")]
    rows += [(7, prose(7), "good.org")] * 2 + [(60, None, "good.org"), (61, "", None), (62, prose(62), None)]
    got = STAGES["quality rules"](spark, table(spark, rows), sf_dir)
    assert got.columns == table(spark, []).columns
    good = [r for r in rows if r[1] and len(r[1]) > 200 and "spam" not in r[1] and r[2] != "bad.org"]
    assert seen(got) == Counter(good)


def test_one_document_of_a_group_stays(spark, sf_dir):
    a, b = prose(1), prose(2)
    near = a.replace("w", "w", 1) + " tail"
    rows = [(9, a, "x"), (3, near, "x"), (3, near, "x"), (4, b, "x"), (4, b, "y"), (4, prose(3), "x"), (8, prose(3), "z")]
    rows += [(None, a, "x"), (None, a, "x"), (20, None, "x"), (21, "", "x"), (22, "one two", "x"), (23, "one two", "x")]
    got = seen(STAGES["n-gram Jaccard join"](spark, table(spark, rows), sf_dir))
    assert Counter(i for i, _, _ in got.elements()) == {3: 1, 4: 1, None: 2, 20: 1, 21: 1, 22: 1}
    assert set(got) <= set(rows) and got[(3, near, "x")] == 1


def test_benchmark_rows_are_told_apart(spark, sf_dir):
    item = next(r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if len(r["text"].split()) >= 12)
    rows = [(1, prose(1), "x"), (1, f"{prose(1)} {item}", "x"), (None, prose(2), "x"), (None, item, "x"), (3, None, "x"), (4, "", None)]
    rows += [(5, prose(5), "x")] * 3
    got = seen(STAGES["benchmark decontamination"](spark, table(spark, rows), sf_dir))
    assert got == Counter(r for r in rows if item not in (r[1] or ""))


def test_mix_takes_what_it_says(spark, sf_dir):
    rows = [(7, prose(7, 300), "a")] * 5 + [(None, prose(8, 200), "b")] * 3 + [(i, prose(i, 150 + i), "abc"[i % 3]) for i in range(40)]
    rows += [(50, None, "a"), (51, "", None), (52, prose(52, 64), None), (7, prose(9, 100), "c")]
    docs = table(spark, rows)
    got = seen(STAGES["mixing sources to target weights"](spark, docs, sf_dir))
    taken, sizes = Counter(), {}
    for r in mix_sources(docs.withColumn("k", docs["n_chars"]), key=("k",)).collect():
        taken[(r["doc_id"], r["size"])] += r["taken"]
        sizes[(r["doc_id"], r["size"])] = r["size"]
    want = Counter()
    for (i, text, source), n in Counter(rows).items():
        size = len((text or "").split())
        lot = int(md5(":".join(["copies", *([str(i)] if i is not None else [])]).encode()).hexdigest()[:8], 16)
        total = taken[(i, size)]
        want[(i, text, source)] = total // size + (lot * size < total % size * 2**32) if size else 0
    assert got == +want
    # Five rows are taken about as often as their words say, not squared.
    assert got[rows[0]] <= 10 and got[(None, prose(8, 200), "b")] <= 6


@pytest.mark.parametrize("name", list(STAGES))
def test_nothing_but_nulls(spark, sf_dir, name):
    docs = table(spark, [(None, None, None)] * 2)
    assert STAGES[name](spark, docs, sf_dir).count() <= 2
    assert STAGES[name](spark, table(spark, []), sf_dir).count() == 0
