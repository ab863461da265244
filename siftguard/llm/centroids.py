"""Centroid clustering with ns-bounds.

Every vector keeps, for each centroid, the distance at its last exact evaluation and the round
of that evaluation. The centroids of all rounds are kept. In a later round the stored distance
is loosened by the norm of the total displacement of the centroid since then, which is never
more than the sum of its drifts round by round. If the upper bound of the own centroid lies
below all lower bounds, the vector stays without any evaluation. Otherwise the own distance is
evaluated, and then only the centroids whose lower bound it reaches.

The vectors are integers and every decision is exact: bounds are floating-point numbers rounded
to the safe side and only ever decide that an evaluation can be left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftguard.llm.vectors import rows_of
from siftguard.session import discard, materialize, spread

# Beyond this a squared distance of 64 components may not fit a long.
LARGEST = 2**27
STATE = "vec_id long, v array<int>, cluster int, distance long, low array<float>, round array<byte>"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _whole(size: int, scale: int):
    """Vectors to integers; others are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = rows_of(batch.column(1), size)
            with np.errstate(over="ignore"):
                x = np.floor(x * scale)
            fits = (np.abs(x) <= LARGEST).all(axis=1)
            at, x = at[fits], x[fits].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), _lists(x, pa.int32())], ["vec_id", "v"]
            )

    return run


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    bounds = np.arange(len(x) + 1) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x.ravel(), kind))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows x to one centroid, or row by row, as longs."""
    d = x.astype(np.int64) - c
    return np.einsum("ij,ij->i", d, d)


def assign(x, cluster, distance, low, last, history: np.ndarray) -> int:
    """Bring clusters, distances and bounds to the last centroids of the history, in place.

    ``history`` is (rounds + 1) x k x size. ``low`` holds distances rounded down, ``last``
    the rounds of their evaluations. Distances of unmoved vectors may be left behind; the
    caller asks for them with ``squared``. Returns the number of exact evaluations.
    """
    now, k = len(history) - 1, history.shape[1]
    n = len(x)
    centroids = history[now]

    def evaluate(rows: np.ndarray, j: int) -> np.ndarray:
        d = squared(x[rows], centroids[j])
        low[rows, j] = np.nextafter(np.sqrt(d.astype(np.float64)).astype(np.float32), np.float32(-1))
        last[rows, j] = now
        return d

    if now == 0:
        best = np.full(n, np.iinfo(np.int64).max)
        for j in range(k):
            d = evaluate(np.arange(n), j)
            better = d < best
            best[better], cluster[better] = d[better], j
        distance[:] = best
        return n * k
    moved = np.sqrt(((history[now] - history).astype(np.float64) ** 2).sum(axis=2)) * (1 + 1e-9)
    drift = moved[last, np.arange(k)]
    lower = low.astype(np.float64) - drift
    lower -= np.abs(lower) * 1e-9
    rows = np.arange(n)
    own = np.nextafter(np.nextafter(low[rows, cluster], np.float32(np.inf)), np.float32(np.inf)).astype(np.float64)
    upper = (own + drift[rows, cluster]) * (1 + 1e-9)
    lower[rows, cluster] = np.inf
    open_rows = np.flatnonzero(upper >= lower.min(axis=1))
    if not len(open_rows):
        return 0
    # The own centroid first; its exact distance closes most of the rest.
    d = squared(x[open_rows], centroids[cluster[open_rows]])
    low[open_rows, cluster[open_rows]] = np.nextafter(np.sqrt(d.astype(np.float64)).astype(np.float32), np.float32(-1))
    last[open_rows, cluster[open_rows]] = now
    reach = lower[open_rows] <= np.sqrt(d.astype(np.float64))[:, None] * (1 + 1e-9)
    best, chosen, used = d.copy(), cluster[open_rows].copy(), len(open_rows)
    for j in np.flatnonzero(reach.any(axis=0)).tolist():
        some = np.flatnonzero(reach[:, j])
        found = evaluate(open_rows[some], j)
        used += len(some)
        better = (found < best[some]) | ((found == best[some]) & (j < chosen[some]))
        best[some[better]], chosen[some[better]] = found[better], j
    cluster[open_rows] = chosen
    return used


def _round(history: np.ndarray, final: bool):
    k = history.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = batch.column(1).flatten().to_numpy().reshape(n, history.shape[2])
            if len(history) == 1:
                cluster, low = np.zeros(n, np.int32), np.zeros((n, k), np.float32)
                last = np.zeros((n, k), np.int8)
            else:
                cluster = batch.column(2).to_numpy().copy()
                low = batch.column(4).flatten().to_numpy().reshape(n, k).copy()
                last = batch.column(5).flatten().to_numpy().reshape(n, k).copy()
            distance = np.zeros(n, np.int64)
            assign(x, cluster, distance, low, last, history)
            if final:
                distance = squared(x, history[-1][cluster])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()),
                _lists(low, pa.float32()), _lists(last, pa.int8()),
            ], ["vec_id", "v", "cluster", "distance", "low", "round"])

    return run


def _sums(k: int, size: int):
    """Count and componentwise sum of each cluster in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            cluster = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(len(cluster), size).astype(np.int64)
            order = np.argsort(cluster, kind="stable")
            if len(order):
                heads = np.flatnonzero(np.concatenate(([True], np.diff(cluster[order]) > 0)))
                sums[cluster[order][heads]] += np.add.reduceat(x[order], heads, axis=0)
                counts += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(counts[some]), _lists(sums[some], pa.int64())], ["cluster", "n", "sums"]
        )

    return run


def _next(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floor of the mean of every cluster that has vectors."""
    k, size = centroids.shape
    parts = state.select("cluster", "v").mapInArrow(_sums(k, size), "cluster int, n long, sums array<long>")
    totals = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(
        F.sum("s").alias("s"), F.sum("n").alias("n")
    )
    out = centroids.copy()
    # k times size rows, whatever the table.
    for r in totals.collect():
        out[r["cluster"], r["i"]] = r["s"] // r["n"]
    return out


def cluster_vectors(
    vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, seed: int = 2
) -> DataFrame:
    """Cluster of every vector after a fixed number of rounds.

    Takes vec_id and embedding; other columns are ignored. Kept are vectors of exactly ``size``
    components, none null or non-finite, each turned into floor(scale * x). Centroids start as
    the vectors with the smallest sha256 of ``seed:vec_id``. A round assigns every vector to
    the nearest centroid (ties: the smaller number) and moves every centroid that has vectors
    to the floor of their mean; then vectors are assigned once more.

    Returns vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.
    Rows that repeat a vec_id are vectors of their own (ties of the start by their components).
    Rows without a vec_id are clustered and returned but start no centroid. Fewer vectors than
    k start fewer centroids; an empty table gives an empty one. Vectors with a component
    beyond 2**27 after scaling are left out, since their distances fit no long; inertias beyond
    a long are null. The work is done when this is called.
    """
    spark = vectors.sparkSession
    whole = spread(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")).mapInArrow(
        _whole(size, scale), "vec_id long, v array<int>"
    )
    state = materialize(whole, "vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = state.filter("vec_id is not null").orderBy(key, "v").limit(k).select("v").collect()
    if not starts:
        return spark.createDataFrame([], RESULT)
    history = np.array([r["v"] for r in starts], np.int64)[None]
    for r in range(rounds + 1):
        assigned = materialize(state.mapInArrow(_round(history, r == rounds), STATE), "assigned")
        discard(state)
        state = assigned
        if r < rounds:
            history = np.concatenate([history, _next(state, history[-1])[None]])
    # k rows.
    totals = {
        r["cluster"]: int(r["s"])
        for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    }
    inertia = sum(totals.values())
    fits = lambda s: s if s < 2**63 else None
    told = [
        (j, fits(s), fits(inertia), hashlib.sha256(",".join(map(str, history[-1][j].tolist())).encode()).hexdigest())
        for j, s in totals.items()
    ]
    clusters = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # At most k rows are broadcast.
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(clusters), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
