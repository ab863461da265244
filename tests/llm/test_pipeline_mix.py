"""The mixing stage of the pipeline: words of the sources against their targets."""

import random
from hashlib import md5

from pyspark.sql import functions as F

import corpus_pipeline
from siftguard.llm.mixing import mix_sources


def test_words_come_to_the_targets(spark, sf_dir):
    rng = random.Random(3)
    docs = spark.createDataFrame(
        [(i, " ".join(["word"] * rng.choice([40, 300, 700])), "en", "abc"[i % 3], 0) for i in range(6000)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    mixed = corpus_pipeline.mixed_sources(spark, docs, sf_dir)
    words = dict(mixed.groupBy("source").agg(F.sum(F.size(F.split("text", " ")))).collect())
    rows = mix_sources(docs).collect()
    goals = {"abc"[r.doc_id % 3]: r.target for r in rows}
    print({s: round(words[s] / goals[s], 3) for s in goals})
    assert all(abs(words[s] / goals[s] - 1) < 0.03 for s in goals)
    # Plain loop over the documents.
    lot = lambda i: int(md5(f"copies:{i}".encode()).hexdigest()[:8], 16)
    want = {r.doc_id: r.taken // r.size + (lot(r.doc_id) * r.size < r.taken % r.size * 2**32) for r in rows}
    assert dict(mixed.groupBy("doc_id").count().collect()) == {i: n for i, n in want.items() if n}
