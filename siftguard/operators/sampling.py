"""Filters, labels, samples, folds and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftguard.operators.running import hash_rank

# Entity labels that make a document confidential.
CRITICAL_ENTITIES = [
    "CREDITCARDNUMBER", "CREDITCARDCVV", "SSN", "IBAN", "ACCOUNTNUMBER", "PASSWORD",
    "BITCOINADDRESS", "ETHEREUMADDRESS", "MASKEDNUMBER", "CREDITCARDISSUER", "PIN",
]


def keep_long_docs(df: DataFrame, text: str = "text", longer_than: int = 80) -> DataFrame:
    """Strip white space at both ends and keep texts longer than a limit."""
    stripped = F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")
    return df.withColumn(text, stripped).filter(F.length(text) > longer_than)


def label_by_topic(df: DataFrame, topic: str, sensitive: list[str], other: list[str]) -> DataFrame:
    """1 for a sensitive topic, 0 for another listed one; the rest is dropped."""
    return df.filter(F.col(topic).isin(*sensitive, *other)).withColumn(
        "label", F.col(topic).isin(*sensitive).cast("int")
    )


def label_by_critical_entity(df: DataFrame, mask: str = "privacy_mask") -> DataFrame:
    """1 if any annotation of the document carries a critical entity label."""
    hit = F.exists(mask, lambda m: m["label"].isin(*CRITICAL_ENTITIES))
    return df.withColumn("label", F.coalesce(hit, F.lit(False)).cast("int"))


def malicious_user_days(intervals: DataFrame) -> DataFrame:
    """Expand inclusive (user, start, end) intervals to distinct days."""
    first, last = F.to_date("start"), F.to_date("end")
    days = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<date>"))
    return intervals.select("user", F.explode(days).alias("date")).distinct()


def hash_of(seed: int, *ids: str) -> Column:
    """Deterministic pseudo-random hexadecimal key of a row."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids]))


def stratified_sample(
    df: DataFrame, label: str, row_id: str, size: int, positive_share: float = 0.3, seed: int = 42
) -> DataFrame:
    """About ``positive_share`` positives, the rest negatives, without replacement.

    ``size`` is bounded by the caller; each label is one top-k pass in hash order,
    so no task ever holds more than ``size`` rows.
    """
    hashed = df.withColumn("__h", hash_of(seed, row_id))
    wanted = int(size * positive_share)
    positives = hashed.filter(F.col(label) == 1).orderBy("__h").limit(wanted)
    negatives = hashed.filter(F.col(label) == 0).orderBy("__h").limit(size)
    both = positives.unionByName(negatives)
    order = Window.partitionBy(label).orderBy("__h")
    ranked = both.withColumn("__rank", F.row_number().over(order)).withColumn(
        "__positives", F.sum(label).over(Window.partitionBy())
    )
    return ranked.filter(
        (F.col(label) == 1) | (F.col("__rank") <= size - F.col("__positives"))
    ).drop("__h", "__rank", "__positives")


def stratified_folds(
    df: DataFrame, label: str, row_id: str, folds: int = 5, seed: int = 42, exact: bool = False
) -> DataFrame:
    """Fold number per row.

    The default takes it from the hash: no shuffle, balanced in expectation.
    ``exact`` deals the rows of each label out in hash order, so that fold sizes
    differ by one at most; ranks come from hash buckets, not from one big window.
    """
    hashed = df.withColumn("__h", hash_of(seed, row_id))
    if not exact:
        number = F.conv(F.substring("__h", 1, 8), 16, 10).cast("long")
        return hashed.withColumn("fold", (number % folds).cast("int")).drop("__h")
    ranked = hash_rank(hashed, [label], "__h", out="__rank")
    return ranked.withColumn("fold", ((F.col("__rank") - 1) % folds).cast("int")).drop("__h", "__rank")


def prefix_split(df: DataFrame, pos: str, warm: int) -> DataFrame:
    """Mark the first ``warm`` positions as train, the others as test."""
    return df.withColumn("part", F.when(F.col(pos) < warm, "train").otherwise("test"))


def exclude_chosen(df: DataFrame, chosen: DataFrame, row_id: str) -> DataFrame:
    """Rows whose id is not among the chosen ones."""
    return df.join(chosen.select(row_id), row_id, "left_anti")
