"""Queries against their SQL twins, and the pipeline against plain loops."""

from hashlib import md5

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftguard.llm.queries import ORACLES, QUERIES
from siftguard.llm.sharding import shard_rows
from tests.compare import compare, connect
from tests.llm import brute


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), QUERIES[name], ORACLES[name], sf_dir) == ""


def test_mix_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text").collect()
    got = [(a, b, c, round(d, 6), e) for a, b, c, d, e in map(tuple, QUERIES["op5_source_mix"](spark, sf_dir).collect())]
    assert sorted(got) == brute.mix([tuple(r) for r in rows])


def test_shard_query(spark, sf_dir):
    got = QUERIES["op8_sharding"](spark, sf_dir).groupBy("shard").agg(
        F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.countDistinct("slot").alias("slots")
    ).collect()
    assert len(got) == 40 and max(r["n"] for r in got) - min(r["n"] for r in got) <= 1
    assert all((r["low"], r["high"], r["slots"]) == (0, r["n"] - 1, r["n"]) for r in got)


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    rows = {r["doc_id"]: (r["source"], r["text"]) for r in docs.collect()}
    kept = [r[0] for r in brute.host_verdicts([(i, s, t) for i, (s, t) in rows.items()]) if r[-1]]
    kept = [i for i, _, c in brute.jaccard([(i, rows[i][1]) for i in kept], 5, 80, 100) if i == c]
    kept = [r[0] for r in brute.benchmark([(i, rows[i][1]) for i in kept], items) if not r[-1]]
    mixed = []
    for i, size, _, _, taken in brute.mix([(i, *rows[i]) for i in kept]):
        lot = int(md5(f"copies:{i}".encode()).hexdigest()[:8], 16)
        mixed += [i] * (taken // size + (lot * size < taken % size * 2**32) if size else 0)
    want = shard_rows(spark.createDataFrame([(i, rows[i][1]) for i in mixed], "doc_id long, text string"))
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert len(mixed) > 50


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf_dir).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0
