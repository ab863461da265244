"""Corpus preparation in stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftguard.llm.decontaminate import find_benchmark
from siftguard.llm.host_quality import judge
from siftguard.llm.jaccard import ngram_jaccard
from siftguard.llm.mixing import mix_sources
from siftguard.llm.sharding import shard_rows
from siftguard.session import materialize, ship_package


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def _keyed(docs: DataFrame) -> tuple[DataFrame, tuple[str, str]]:
    """Rows with two hashes of all their columns, and the names of these.

    Verdicts are joined to rows by them: equal rows have equal verdicts, and rows that share
    a doc_id only are told apart.
    """
    names: list[str] = []
    while len(names) < 2:
        name = f"row_{len(names)}"
        while name in docs.columns:
            name += "_"
        names.append(name)
    columns = _columns(docs)
    parts = [*columns, *[c.isNull() for c in columns]]
    keyed = docs.select("*", *[F.xxhash64(F.lit(i), *parts).alias(n) for i, n in enumerate(names)])
    return keyed, tuple(names)


def _keep(docs: DataFrame, keyed: DataFrame, key: tuple[str, str], kept: DataFrame) -> DataFrame:
    """Rows of docs whose key is among the kept ones."""
    return keyed.join(kept.select(*key).distinct().hint("merge"), list(key), "left_semi").select(_columns(docs))


def passing_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and their host's record let pass.

    Every row is judged on its own: rows that repeat a doc_id, with other texts or sources, may
    fare differently, equal rows fare alike. A null doc_id is no reason to leave; null and empty
    texts have too few words and leave. Extra columns stay, whatever their names.
    """
    ship_package(spark)
    keyed, key = _keyed(docs)
    return _keep(docs, keyed, key, judge(keyed, key=key).filter("kept"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link by five-word shingles at 0.8 the one with the smallest id.

    A doc_id names a document: rows that repeat it are one document, which links by each of their
    texts, and of which one row stays (that of the least hash). Null and empty texts link with
    nothing and stay. Rows without a doc_id cannot be named in a group and stay.
    """
    ship_package(spark)
    leaders = ngram_jaccard(docs, n=5, num=80, den=100).filter("component_id = doc_id").select("doc_id").distinct()
    keyed, key = _keyed(docs)
    named = keyed.filter("doc_id is not null").join(leaders.hint("merge"), "doc_id", "left_semi")
    every = F.struct(*_columns(docs))
    one = named.groupBy("doc_id").agg(F.min_by(every, F.struct(*key)).alias("row")).select("row.*")
    return one.union(docs.filter("doc_id is null"))


def free_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Rows are searched one by one, whatever their doc_id, null included. Null and empty texts
    hold no window and stay; without items everything stays.
    """
    ship_package(spark)
    keyed, key = _keyed(docs)
    found = find_benchmark(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=key)
    return _keep(docs, keyed, key, found.filter("not contaminated"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row stands as often as its words are taken on average, none included.

    The average is rounded up with the probability of its fraction, by a hash of the id, so that
    the words of a source come to its target on average. Equal rows are rounded together:
    what the mix takes of all of them decides how many there are. A null doc_id or source is one
    like any other. Texts without words (null, empty) are never taken and leave.
    """
    ship_package(spark)
    keyed, key = _keyed(docs)
    copies, total, size = "copies", F.col("total"), F.nullif(F.col("size"), F.lit(0))
    while copies in keyed.columns:
        copies += "_"
    lot = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("copies"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("long")
    # A text without words has no average; the optimiser may move the filters.
    up = lot * size < total % size * F.lit(2**32)
    taken = mix_sources(keyed, key=key).groupBy(*key).agg(
        F.sum("taken").alias("total"), F.max("size").alias("size"), F.max("doc_id").alias("doc_id")
    ).select(*key, (F.floor(total / size) + up.cast("int")).cast("int").alias(copies)).filter(F.col(copies) > 0)
    once = keyed.dropDuplicates(list(key))
    repeated = once.join(taken.hint("merge"), list(key)).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return repeated.select(_columns(docs))


def placed_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix.

    Rows are placed one by one, repeated ones included; a null text is empty, a null doc_id is
    an id like any other.
    """
    ship_package(spark)
    return shard_rows(docs)


STAGES = [
    ("quality rules", passing_quality_rules),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", free_of_benchmarks),
    ("mixing sources to target weights", mixed_sources),
    ("sharding", placed_in_shards),
]

# The ring walk of the last stage cannot be written in SQL; a brute-force version checks the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
