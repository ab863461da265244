"""Comparison of rule policies with MLlib classifiers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftguard.operators.bitmaps import build_index
from siftguard.operators.metrics import binary_metrics
from siftguard.operators.rule_search import SearchSettings, evolve_many, survey_columns
from siftguard.operators.rules import apply_rule_set
from siftguard.operators.tfidf import assemble_features, fold_vocabularies, tfidf_fit, vocabulary_rows, word_columns
from siftguard.session import keep_hot

MODELS: dict[str, Callable] = {
    "RandomForest": lambda seed: RandomForestClassifier(numTrees=200, maxDepth=8, seed=seed),
    "GradientBoosting": lambda seed: GBTClassifier(maxIter=20, maxDepth=3, seed=seed),
    "LinearSVM": lambda seed: LinearSVC(maxIter=50, regParam=0.01),
    "LogisticRegression": lambda seed: LogisticRegression(maxIter=100, regParam=0.01),
    "NaiveBayes": lambda seed: NaiveBayes(modelType="multinomial"),
}

METRICS_SCHEMA = (
    "model string, fold int, tp long, fp long, fn long, tn long, precision double, recall double, f1 double"
)


def shift_to_positive(train: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """Move features by their smallest training value, where that is below zero."""
    low = train.select(Summarizer.min(F.col("features")).alias("m")).first()["m"].toArray()
    if (low >= 0).all():
        return list(tables)
    shifts = F.array(*[F.lit(float(min(v, 0.0))) for v in low])
    moved = F.zip_with(vector_to_array("features"), shifts, lambda x, s: F.greatest(x - s, F.lit(0.0)))
    return [t.withColumn("features", array_to_vector(moved)) for t in tables]


def split_features(
    tokenized: DataFrame, test_fold: int, vocabulary: list[tuple[str, float]]
) -> tuple[DataFrame, DataFrame]:
    """Train and test vectors; the vocabulary was learnt on the training folds only."""
    both = assemble_features(tokenized, vocabulary).select("fold", "label", "features")
    both = keep_hot(both, 20_000)
    return both.filter(F.col("fold") != test_fold), both.filter(F.col("fold") == test_fold)


def _evaluate(model, test: DataFrame) -> tuple:
    predicted = model.transform(test).select("label", F.col("prediction").cast("int").alias("predicted"))
    return tuple(binary_metrics(predicted, "label", "predicted").first())


def cross_validate_baselines(
    tokenized: DataFrame, folds: int = 5, models: list[str] | None = None, seed: int = 42, size: int = 300
) -> DataFrame:
    """Fold metrics of every model on (fold, label, tokens, identifier features).

    Folds run side by side as Spark jobs; the driver sees the metrics only.
    """
    spark: SparkSession = tokenized.sparkSession
    names = models or list(MODELS)
    vocabularies = fold_vocabularies(tokenized, folds, size)

    def one_fold(fold: int) -> list[tuple]:
        train, test = split_features(tokenized, fold, vocabularies[fold])
        rows = []
        for name in names:
            a, b = shift_to_positive(train, train, test) if name == "NaiveBayes" else (train, test)
            rows.append((name, fold, *_evaluate(MODELS[name](seed + fold).fit(a), b)))
        return rows

    with ThreadPool(folds) as pool:
        found = [row for rows in pool.map(one_fold, range(folds)) for row in rows]
    return spark.createDataFrame(found, METRICS_SCHEMA)


def label_budget_curve(
    base: DataFrame, extra: DataFrame, test: DataFrame, budgets: tuple[int, ...] = (10, 50, 200),
    order: str = "__h", seed: int = 0, size: int = 300,
) -> DataFrame:
    """F1 of a forest refitted with k labelled documents of a new kind, per k.

    The k documents are the first ones in hash order (column ``order`` of ``extra``).
    """
    spark = base.sparkSession

    def one(k: int) -> tuple:
        taken = extra.orderBy(order).limit(k)
        train = base.unionByName(taken.drop(order))
        vocabulary = vocabulary_rows(tfidf_fit(train, size))
        vectors = keep_hot(assemble_features(train, vocabulary).select("label", "features"), 20_000)
        model = MODELS["RandomForest"](seed + k).fit(vectors)
        return (k, *_evaluate(model, assemble_features(test, vocabulary)))

    with ThreadPool(len(budgets)) as pool:
        rows = pool.map(one, budgets)
    return spark.createDataFrame(
        rows, "budget int, tp long, fp long, fn long, tn long, precision double, recall double, f1 double"
    )


def lambda_sensitivity(
    df: DataFrame, label: str, features: list[str], lams: tuple[float, ...] = (0.0, 0.02, 0.05, 0.1, 0.2),
    folds: int = 3, settings: SearchSettings | None = None, size: int = 300,
) -> DataFrame:
    """Test F1 and number of rules per complexity weight and fold.

    ``df`` has a ``fold`` column; folds run side by side, all weights of a fold in the same jobs. With a
    column ``tokens`` the weights of ``size`` words, learnt on the training folds, are searched too.
    """
    base = settings or SearchSettings()

    def one_fold(fold: int) -> list[tuple]:
        rows, names = df, features
        if "tokens" in df.columns:
            rows, words = word_columns(df, vocabulary_rows(tfidf_fit(df.filter(F.col("fold") != fold), size)))
            rows, names = keep_hot(rows), [*words, *features]
        train = rows.filter(F.col("fold") != fold)
        index = build_index(train, label, names)
        # What does not depend on lambda is found once; the weights go through the generations in step.
        survey = survey_columns(train, label, names, base, index)
        found = evolve_many(index, survey, [replace(base, lam=lam, seed=base.seed + fold) for lam in lams])
        out = []
        for lam, result in zip(lams, found):
            scored = apply_rule_set(rows.filter(F.col("fold") == fold), result.rules)
            out.append((lam, fold, binary_metrics(scored, label, "predicted").first()["f1"], len(result.rules)))
        index.blocks.unpersist()
        return out

    with ThreadPool(folds) as pool:
        rows = [row for found in pool.map(one_fold, range(folds)) for row in found]
    return df.sparkSession.createDataFrame(rows, "lam double, fold int, f1 double, n_rules int")
