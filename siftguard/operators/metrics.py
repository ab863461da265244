"""Classification, ranking and summary metrics."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftguard.operators.running import quantile_bucket, running


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def confusion(df: DataFrame, label: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn in one aggregate."""
    y, p = F.col(label), F.col(predicted)

    def n(cond: Column) -> Column:
        return F.count_if(cond)

    return df.groupBy(*(by or [])).agg(
        n((y == 1) & (p == 1)).alias("tp"),
        n((y == 0) & (p == 1)).alias("fp"),
        n((y == 1) & (p == 0)).alias("fn"),
        n((y == 0) & (p == 0)).alias("tn"),
    )


def f1_column(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 from counts, 0 if there is nothing to divide by."""
    return _ratio(2.0 * tp, 2 * tp + fp + fn)


def with_scores(counts: DataFrame) -> DataFrame:
    """precision, recall, F1 and the two alarm error rates from the counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (
        counts.withColumn("precision", _ratio(tp, tp + fp))
        .withColumn("recall", _ratio(tp, tp + fn))
        .withColumn("f1", f1_column(tp, fp, fn))
        .withColumn("fnr", 1.0 - F.col("recall"))
        .withColumn("fpr", fp / F.greatest(fp + tn, F.lit(1)))
    )


def binary_metrics(df: DataFrame, label: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """precision, recall and F1, 0 on zero division."""
    return with_scores(confusion(df, label, predicted, by)).select(
        *(by or []), "tp", "fp", "fn", "tn", "precision", "recall", "f1"
    )


def alarm_error_rates(df: DataFrame, label: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Missed share of positives and alarmed share of negatives."""
    return with_scores(confusion(df, label, predicted, by)).select(*(by or []), "fnr", "fpr")


def fold_mean_std(results: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Mean and population deviation over repeats; NULL and NaN are skipped."""
    clean = F.when(~F.isnan(value), F.col(value))
    return results.groupBy(*by).agg(
        F.avg(clean).alias("mean"), F.stddev_pop(clean).alias("std"), F.count(clean).alias("n")
    )


def ranking_curve(scores: DataFrame, score: str, label: str) -> DataFrame:
    """Per distinct score: positives and negatives there and above it.

    Equal scores are merged before any ordering, so a score shared by many users is
    one row; the running sums are cut into quantile buckets.
    """
    groups = scores.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("p"),
        F.sum((1 - F.col(label)).cast("long")).alias("n"),
    )
    groups = groups.withColumn("__descending", -F.col("score")).persist(StorageLevel.MEMORY_AND_DISK)
    bucket = quantile_bucket(groups, "__descending")
    return running(
        groups.withColumn("__all", F.lit(1)), ["__all"], bucket, ["__descending"],
        {"cum_p": ("sum", F.col("p")), "cum_n": ("sum", F.col("n"))},
    ).drop("__all", "__descending")


def ranking_metrics(
    scores: DataFrame, score: str, label: str, row_id: str, budgets: tuple[int, ...] = (20, 50, 100)
) -> DataFrame:
    """AUC, average precision and precision/recall at budgets, one row each.

    Ties count half in the AUC; average precision steps over distinct scores; top-k
    order is score descending, then id.
    """
    curve = ranking_curve(scores, score, label)
    p, n, cum_p, cum_n = (F.col(c) for c in ("p", "n", "cum_p", "cum_n"))
    summary = curve.agg(
        F.sum("p").alias("positives"),
        F.sum("n").alias("negatives"),
        F.sum(n * (cum_p - p) + 0.5 * p * n).alias("ordered_pairs"),
        F.sum(p * cum_p / (cum_p + cum_n)).alias("precision_mass"),
    )
    summary = summary.select(
        F.explode(
            F.array(
                F.struct(
                    F.lit("auc").alias("metric"),
                    (F.col("ordered_pairs") / F.nullif(F.col("positives") * F.col("negatives"), F.lit(0))).alias("value"),
                ),
                F.struct(
                    F.lit("ap").alias("metric"),
                    _ratio(F.col("precision_mass"), F.col("positives")).alias("value"),
                ),
                F.struct(
                    F.lit("positives").alias("metric"), F.col("positives").cast("double").alias("value")
                ),
            )
        ).alias("m")
    ).select("m.*")
    largest = max(budgets)
    top = scores.select(F.col(row_id), F.col(score), F.col(label)).orderBy(F.desc(score), F.asc(row_id)).limit(largest)
    # At most `largest` rows in order: one array, then one slice per budget.
    ordered = top.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(row_id).alias("i"), F.col(label).alias("y")))),
            lambda e: e["y"],
        ).alias("ys")
    )
    total = scores.agg(F.sum(F.col(label).cast("long")).alias("positives"))
    rows = ordered.select("ys", F.explode(F.array(*[F.lit(b) for b in budgets])).alias("k")).select(
        "k",
        F.aggregate(F.slice("ys", F.lit(1), F.col("k")), F.lit(0).cast("long"), lambda a, y: a + y).alias("hits"),
    )
    rows = rows.withColumn("positives", total.scalar())
    at_k = rows.select(
        F.explode(
            F.array(
                F.struct(
                    F.concat(F.lit("precision@"), F.col("k").cast("string")).alias("metric"),
                    (F.col("hits") / F.col("k")).alias("value"),
                ),
                F.struct(
                    F.concat(F.lit("recall@"), F.col("k").cast("string")).alias("metric"),
                    _ratio(F.col("hits"), F.col("positives")).alias("value"),
                ),
            )
        ).alias("m")
    ).select("m.*")
    return summary.unionByName(at_k)
