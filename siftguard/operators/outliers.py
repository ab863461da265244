"""Population outlier scores: isolation forest and local outlier factor.

A forest is grown from bounded random samples (the published method) and scores in one
narrow pass. The outlier factor compares every row with its nearest training rows, all of
which count.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftguard.operators.neighbours import nearest_rows
from siftguard.operators.running import percentiles
from siftguard.operators.sampling import hash_of
from siftguard.session import by_group, materialize


def standard_scale(
    df: DataFrame, features: list[str], train: DataFrame
) -> DataFrame:
    """z-values by mean and population deviation of the training rows; deviation 0 -> 1."""
    stats = train.agg(
        *[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)],
        *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)],
    ).first()
    scaled = {
        f: (F.col(f) - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"] or 1.0) for i, f in enumerate(features)
    }
    return df.withColumns(scaled)


def bounded_sample(df: DataFrame, ids: list[str], size: int, seed: int) -> DataFrame:
    """``size`` rows in hash order: each task keeps its own top rows, one merges them."""
    return df.withColumn("__h", hash_of(seed, *ids)).orderBy("__h").limit(size).drop("__h")


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    deep = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + np.euler_gamma) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n > 2, deep, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, depth_limit: int) -> list[tuple]:
    """Random splits as a list of nodes (feature, threshold, left, right, path length)."""
    nodes: list[list] = [[]]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        spread = np.ptp(x[rows], axis=0) if len(rows) > 1 else np.zeros(x.shape[1])
        usable = np.flatnonzero(spread > 0)
        if depth >= depth_limit or not len(usable):
            nodes[at] = [-1, 0.0, at, at, depth + float(_mean_path(len(rows)))]
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(x[rows, f].min(), x[rows, f].max()))
        goes_left = x[rows, f] <= cut
        left, right = len(nodes), len(nodes) + 1
        nodes += [[], []]
        nodes[at] = [f, cut, left, right, 0.0]
        todo += [(left, rows[goes_left], depth + 1), (right, rows[~goes_left], depth + 1)]
    return nodes


def isolation_forest_fit(
    train: DataFrame, features: list[str], ids: list[str], trees: int = 300, sample: int = 256, seed: int = 0
) -> tuple[list[list], int]:
    """Trees from independent samples, grown in parallel.

    The hash-ordered pool has at most ``trees * sample`` rows. A pool too small for
    disjoint samples is dealt out several times, in another order each time. Returns
    the nodes per tree (bounded by trees and sample) and the sample size.
    """
    pool = bounded_sample(train.select(*ids, *features), ids, trees * sample, seed)
    n = pool.count()
    per_copy = max(1, min(trees, n // sample))
    copies = ceil(trees / per_copy)
    size = min(sample, n)
    dealt = pool.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__copy").cast("string"), *[F.col(i).cast("string") for i in ids]))
    # Dealt out by rank, so that every tree has a full sample; the pool is bounded.
    slot = (F.row_number().over(Window.partitionBy("__copy").orderBy(key)) - 1) % per_copy
    dealt = dealt.select(
        (F.col("__copy") * per_copy + slot).alias("tree_id"), key.alias("__key"), *features
    ).filter(F.col("tree_id") < trees)

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("__key").head(sample)[features].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, int(key[0])])
        nodes = _grow(rows, rng, max(1, ceil(log2(max(size, 2)))))
        out = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "path"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree_id", key[0])
        return out

    grown = by_group(dealt, "tree_id").groupBy("tree_id").applyInPandas(
        grow, "tree_id long, node int, feature int, cut double, left int, right int, path double"
    )
    per_tree = grown.groupBy("tree_id").agg(
        F.array_sort(F.collect_list(F.struct("node", "feature", "cut", "left", "right", "path"))).alias("nodes")
    )
    forest = [[tuple(n)[1:] for n in r.nodes] for r in per_tree.orderBy("tree_id").collect()]
    return forest, size


def isolation_forest_score(
    df: DataFrame, features: list[str], keep: list[str], forest: list[list], size: int
) -> DataFrame:
    """Adds ``outlier``: near 1 for rows that few splits isolate."""
    tables = [np.array(t, dtype=float) for t in forest]
    depth_limit = max(1, ceil(log2(max(size, 2))))
    norm = float(_mean_path(size)) or 1.0
    shared = df.sparkSession.sparkContext.broadcast(tables)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features])
            rows = np.arange(len(x))
            total = np.zeros(len(x))
            for t in shared.value:
                at = np.zeros(len(x), dtype=np.int64)
                for _ in range(depth_limit):
                    f = t[at, 0].astype(np.int64)
                    left = x[rows, np.maximum(f, 0)] <= t[at, 1]
                    at = np.where(left, t[at, 2], t[at, 3]).astype(np.int64)
                total += t[at, 4]
            value = np.exp2(-total / len(shared.value) / norm)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(value)], names=[*keep, "outlier"]
            )

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep) + ", outlier double"
    return df.select(*keep, *[f for f in features if f not in keep]).mapInArrow(score, schema)


def isolation_forest(
    df: DataFrame, train: DataFrame, features: list[str], ids: list[str], keep: list[str],
    trees: int = 300, sample: int = 256, seed: int = 0,
) -> DataFrame:
    forest, size = isolation_forest_fit(train, features, ids, trees, sample, seed)
    return isolation_forest_score(df, features, keep, forest, size)


def local_outlier_factor(
    df: DataFrame, train: DataFrame, features: list[str], ids: list[str], keep: list[str], neighbors: int = 30,
    block_rows: int = 2_000,
) -> DataFrame:
    """Adds ``outlier``: density around the nearest training rows over the own density.

    All training rows are used; equal ones are one point with a weight, so that the time follows
    the distinct vectors. A row to be scored may be a training row too; then it is its own
    nearest neighbour. ``ids`` settle the order of training rows at equal distances.
    """
    vector = F.array(*[F.col(f).cast("double") for f in features]).alias("x")
    points = materialize(
        train.select(F.xxhash64(*ids).alias("point"), vector).groupBy("x").agg(
            F.min("point").alias("point"), F.count("*").alias("weight")
        ),
        "lof-points",
    )
    k = max(1, min(neighbors, (points.agg(F.sum("weight")).first()[0] or 0) - 1))
    # Equal rows have equal scores: distinct vectors are searched once. A training vector is searched by
    # the number of its point, without one copy of itself.
    rows, key = df.select(*keep, vector), F.xxhash64("x", F.lit("query")).alias("key")
    known = points.select("x", F.col("point").alias("own"))
    vectors = materialize(
        rows.select("x").union(points.select("x")).distinct().join(known, "x", "left")
        .select("x", key, F.coalesce("own", key).alias("query"), F.col("own").isNotNull().alias("trained")),
        "lof-vectors",
    )
    near = materialize(nearest_rows(vectors, points, k, block_rows), "lof-near")
    trained = vectors.filter("trained").select("query")
    reach = materialize(near.groupBy("query").agg(F.max("dist").alias("reach")).join(trained, "query"), "lof-reach")

    # As a row to be scored, a training vector has itself for its last neighbour.
    n, with_own = F.col("n"), F.col("n") - F.when(F.col("upto") >= k, 1).otherwise(0)

    def sums(value: Column, looked_up: DataFrame) -> DataFrame:
        return near.join(looked_up, "point").groupBy("query").agg(
            F.sum(n * value).alias("sum"), F.sum("n").alias("n"),
            F.sum(with_own * value).alias("sum_own"), F.sum(with_own).alias("n_own"),
        )

    def mean(own: str) -> Column:
        whole = (F.col("sum_own") + F.col(own)) / (F.col("n_own") + 1)
        return F.when(F.col(own).isNotNull(), whole).otherwise(F.col("sum") / F.col("n"))

    def density(distance: Column) -> Column:
        return 1.0 / (distance + 1e-10)

    apart = sums(F.greatest("reach", "dist"), reach.withColumnRenamed("query", "point")).join(reach, "query", "left")
    dense = materialize(
        apart.select(
            "query", density(mean("reach")).alias("density"),
            F.when(F.col("reach").isNotNull(), density(F.col("sum") / F.col("n"))).alias("trained"),
        ),
        "lof-density",
    )
    theirs = dense.filter("trained is not null").select(F.col("query").alias("point"), F.col("trained").alias("theirs"))
    scored = sums(F.col("theirs"), theirs).join(dense, "query").select(
        "query", (mean("trained") / F.col("density")).alias("outlier")
    )
    keyed = vectors.select("key", "query").join(scored, "query")
    return rows.select(*keep, key).join(keyed, "key").select(*keep, "outlier")


def global_user_scores(scored: DataFrame, split_day: int, user: str = "user") -> DataFrame:
    """Peak daily outlier score per user on the test days."""
    return scored.filter(F.col("day") >= split_day).groupBy(user).agg(F.max("outlier").alias("risk"))


def outlier_alarms(
    scored: DataFrame, split_day: int, least_share: float = 0.005
) -> DataFrame:
    """Day-level alarms: the cut lets the train share of malicious days pass.

    The share is ``max(train rate, least_share)`` and the cut the matching quantile of
    the training scores, which is exact.
    """
    train = scored.filter(F.col("day") < split_day)
    # Two numbers on the driver: the share, then the cut.
    rate = train.agg(F.avg("label")).first()[0] or 0.0
    point = 1.0 - max(rate, least_share)
    cuts = percentiles(train.select("outlier"), [], "outlier", [point]).first()
    limit = cuts[0][0] if cuts else None
    return scored.filter(F.col("day") >= split_day).withColumn(
        "alarm", (F.col("outlier") > F.lit(limit)).cast("int")
    )
