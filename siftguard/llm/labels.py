"""Labelled rows to learn from: a bounded, seeded choice that leaves the held-out fold alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in the held-out fold; false without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int) -> DataFrame:
    """doc_id, text, label (int) and a seeded ``part`` from 0 to 9 of at most ``rows`` labelled documents.

    The choice is by hash of the id, so it is the same in every run. Only ids and labels of
    at most ``rows`` rows are broadcast.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(folds, fold))
    order = F.xxhash64("doc_id", F.lit(7))
    chosen = known.select("doc_id", F.col(label).cast("int").alias("label")).orderBy(order, "doc_id", "label").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn(
        "part", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(10)).cast("int")
    )
