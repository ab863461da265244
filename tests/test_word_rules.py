"""The rule queries search the weights of words next to the identifier features."""

from pyspark.sql import functions as F

from siftguard.plans.registry import QUERIES


def test_a_rule_on_a_word_is_found(spark, tmp_path):
    texts = [f"plain text about {'project bluegarden' if i % 3 == 0 else 'project holidayfun'} number" for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    rows = QUERIES["sequential_covering"](spark, str(tmp_path)).collect()
    spark.catalog.clearCache()
    assert len(rows) == 1 and rows[0].f1 == 1.0
    assert "word_bluegarden >" in rows[0].rule or "word_holidayfun <" in rows[0].rule
