"""Policies under drift: versions, test-then-train scores and their comparison.

Alarms depend on features only, never on predictions. So all refit points are known
first; the fits are independent, each on a bounded window; and every row is scored
once by the version that is active at its position.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftguard.operators.drift import KsRule, exploring_rule, ks_confirm_detector, trailing_rule
from siftguard.operators.models import MODELS
from siftguard.operators.running import running, trailing_mean
from siftguard.session import by_group, materialize, scratch_path

_BLOCK = 50_000


def prequential_accuracy(trace: DataFrame, window: int = 500, keys: list[str] | None = None) -> DataFrame:
    """Trailing mean of correctness, shorter at the start."""
    return trailing_mean(trace, keys or ["stream_id"], "pos", "correct", window, "accuracy")


def first_versions(stream: DataFrame, warm: int) -> DataFrame:
    """Version 0 of every stream: fitted on the warm prefix, active after it."""
    return stream.select("stream_id").distinct().select(
        "stream_id",
        F.lit(0).cast("long").alias("fit_pos"),
        F.lit(0).cast("long").alias("train_from"),
        F.lit(warm).cast("long").alias("train_to"),
        F.lit(warm).cast("long").alias("active_from"),
    )


def refit_versions(alarms: DataFrame, lengths: DataFrame, delays: tuple[int, ...], rows: int) -> DataFrame:
    """Versions fitted ``delays`` after each alarm on the last ``rows`` rows.

    A row is scored before the model that uses the rows before it takes over, so a
    version fitted at ``i`` is active from ``i + 1``.
    """
    fits = alarms.join(lengths, "stream_id").select(
        "stream_id", "__n", F.explode(F.array(*[F.lit(d) for d in delays])).alias("__d"), "alarm_pos"
    ).withColumn("fit_pos", F.col("alarm_pos") + F.col("__d"))
    return fits.filter(F.col("fit_pos") < F.col("__n")).select(
        "stream_id", "fit_pos",
        F.greatest(F.col("fit_pos") - rows, F.lit(0)).cast("long").alias("train_from"),
        F.col("fit_pos").alias("train_to"),
        (F.col("fit_pos") + 1).alias("active_from"),
    )


def policy_for_segment(stream: DataFrame, versions: DataFrame, block: int = _BLOCK) -> DataFrame:
    """Each row with the ``fit_pos`` of the version that is active at its position.

    An as-of join as a running maximum over rows and version starts together, in
    blocks of positions: no range join, and no stream in one task.
    """
    rows = stream.withColumn("__from", F.lit(None).cast("long")).withColumn("__fit", F.lit(None).cast("long"))
    starts = versions.select(
        "stream_id", F.col("active_from").alias("pos"), F.col("active_from").alias("__from"),
        F.col("fit_pos").alias("__fit"),
    )
    both = rows.unionByName(starts, allowMissingColumns=True)
    latest = running(
        both, ["stream_id"], F.floor(F.col("pos") / block), ["pos", F.col("__from").asc_nulls_last()],
        {"__latest": ("max", F.when(F.col("__from").isNotNull(), F.struct("__from", "__fit")))},
    )
    known = latest.filter(F.col("__from").isNull() & F.col("__latest").isNotNull())
    return known.select(*stream.columns, F.col("__latest.__fit").alias("fit_pos"))


def versions_by_block(stream: DataFrame, versions: DataFrame, block: int = _BLOCK) -> DataFrame:
    """For each block of rows: the version active at its start and those that start in it."""
    blocks = stream.select("stream_id", F.floor(F.col("pos") / block).cast("long").alias("block")).distinct()
    marks = blocks.select("stream_id", (F.col("block") * block).alias("pos"), "block")
    at_start = policy_for_segment(marks, versions, block * 1_000).select("stream_id", "block", "fit_pos")
    inside = versions.select(
        "stream_id", F.floor(F.col("active_from") / block).cast("long").alias("block"), "fit_pos"
    )
    return at_start.unionByName(inside).distinct().join(
        versions.select("stream_id", "fit_pos", "active_from"), ["stream_id", "fit_pos"]
    )


def fit_versions(stream: DataFrame, versions: DataFrame, kind: str, block: int = _BLOCK) -> DataFrame:
    """One model per version, each fitted in its own task on its bounded window."""
    fit, _, _ = MODELS[kind]
    listed = versions.withColumn(
        "__block",
        F.explode(
            F.sequence(
                F.floor(F.col("train_from") / block).cast("long"),
                F.floor((F.col("train_to") - 1) / block).cast("long"),
            )
        ),
    )
    rows = stream.withColumn("__block", F.floor(F.col("pos") / block).cast("long"))
    inside = (F.col("pos") >= F.col("train_from")) & (F.col("pos") < F.col("train_to"))
    training = rows.join(listed, ["stream_id", "__block"]).filter(inside)
    stream_type = stream.schema["stream_id"].dataType.simpleString()

    def train(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        model = fit(np.stack(pdf["features"].to_numpy()), pdf["y"].to_numpy(dtype=np.int64))
        flat = [float(v) for row in model for v in row]
        return pd.DataFrame({"stream_id": [key[0]], "fit_pos": [key[1]], "model": [flat]})

    return (
        by_group(training.select("stream_id", "fit_pos", "pos", "features", "y"), "stream_id", "fit_pos")
        .groupBy("stream_id", "fit_pos")
        .applyInPandas(train, f"stream_id {stream_type}, fit_pos long, model array<double>")
    )


def score_versions(
    stream: DataFrame, versions: DataFrame, models: DataFrame, kind: str, block: int = _BLOCK
) -> DataFrame:
    """(stream_id, pos, fit_pos, predicted, correct) for every row of an active version.

    Rows meet the versions of their block of positions, never those of a whole stream.
    """
    _, predict, width = MODELS[kind]
    listed = versions_by_block(stream, versions, block).join(models, ["stream_id", "fit_pos"])
    # Aliased key: both sides of the cogroup come from the same stream.
    listed = listed.select(F.col("stream_id").alias("stream_id"), "block", "fit_pos", "active_from", "model")
    rows = stream.select("stream_id", "pos", "features", "y", F.floor(F.col("pos") / block).cast("long").alias("block"))
    stream_type = stream.schema["stream_id"].dataType.simpleString()

    def score(key: tuple, rows: pa.Table, models: pa.Table) -> pa.Table:
        known = sorted(models.to_pylist(), key=lambda v: v["active_from"])
        pos, y = rows.column("pos").to_numpy(), rows.column("y").to_numpy()
        active = np.searchsorted([v["active_from"] for v in known], pos, side="right") - 1
        predicted = np.zeros(len(pos), dtype=np.int32)
        fitted = np.array([v["fit_pos"] for v in known] or [0], dtype=np.int64)[active]
        if len(pos):
            x = rows.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            x = x.reshape(len(pos), -1)
            for i in np.unique(active[active >= 0]):
                mine = active == i
                model = np.asarray(known[i]["model"], dtype=float).reshape(-1, width)
                predicted[mine] = predict(model, x[mine])
        out = pa.table(
            {
                "stream_id": pa.repeat(key[0], len(pos)), "pos": pos, "fit_pos": fitted,
                "predicted": predicted, "correct": (predicted == y).astype(np.int32),
            }
        )
        return out.filter(pa.array(active >= 0))

    keys = ("stream_id", "block")
    return (
        by_group(rows, *keys)
        .groupBy(*keys)
        .cogroup(by_group(listed, *keys).groupBy(*keys))
        .applyInArrow(score, f"stream_id {stream_type}, pos long, fit_pos long, predicted int, correct int")
    )


def _evaluate(stream: DataFrame, versions: DataFrame, kind: str) -> DataFrame:
    versions = materialize(versions, "versions")
    models = materialize(fit_versions(stream, versions, kind), "models")
    return score_versions(stream, versions, models, kind)


def static_policy(stream: DataFrame, warm: int, kind: str = "rules") -> DataFrame:
    """Fit on the prefix, score the rest, never update."""
    return _evaluate(stream, first_versions(stream, warm), kind)


def _lengths(stream: DataFrame) -> DataFrame:
    return stream.groupBy("stream_id").agg((F.max("pos") + 1).alias("__n"))


def adaptive_rule_policy(
    stream: DataFrame,
    warm: int,
    refit_rows: int = 300,
    refits: tuple[int, ...] = (0, 300, 600),
    rule: KsRule | None = None,
) -> DataFrame:
    """Rules refitted in a series after each confirmed alarm.

    The refit planned for the alarm position itself takes place one row later, as the
    row has been scored by then.
    """
    alarms = ks_confirm_detector(stream, rule or exploring_rule(warm, last_refit=refits[-1]), name="explore")
    delays = tuple(max(d, 1) for d in refits)
    later = refit_versions(alarms, _lengths(stream), delays, refit_rows)
    return _evaluate(stream, first_versions(stream, warm).unionByName(later), "rules")


def adaptive_tree_policy(
    stream: DataFrame, warm: int, window: int = 1_000, refit_rows: int = 3_000, rule: KsRule | None = None
) -> DataFrame:
    """A tree refitted once at each confirmed alarm on the last rows."""
    alarms = ks_confirm_detector(stream, rule or trailing_rule(warm, window), name="trailing")
    later = refit_versions(alarms, _lengths(stream), (0,), refit_rows)
    return _evaluate(stream, first_versions(stream, warm).unionByName(later), "tree")


def _step(w: np.ndarray | None, x: np.ndarray, y: np.ndarray, rate: float) -> np.ndarray | None:
    """Weights moved by the mean gradient of the rows; unknown (None) if no row can be used."""
    if w is None or not len(x):
        return None
    with np.errstate(over="ignore", invalid="ignore"):
        error = (y[:, None] == np.arange(len(w))) - 1.0 / (1.0 + np.exp(-(x @ w.T)))
        return w + rate * (error.T @ x) / len(x)


def incremental_policy(
    stream: DataFrame, warm: int, block_rows: int = 1_000, rate: float = 1.0, warm_steps: int = 8,
    round_values: int = 2_000_000,
) -> DataFrame:
    """Logistic model updated after every ``block_rows`` rows; a block is scored before it is learnt.

    One against the rest for several classes. Blocks are counted per stream, so a stream's
    result does not depend on others. The weights of a block follow from those before it: a
    round walks all streams side by side through the next blocks, as many as hold about
    ``round_values`` values of a stream, and writes the weights before each block. A task gets
    that part of one stream, or its warm prefix. All rows are then scored at once, by a join
    with the weights of their block.
    """
    spark = stream.sparkSession
    path, rounds = scratch_path(spark, "incremental"), scratch_path(spark, "incremental-rounds")
    shape = stream.agg(F.max("pos"), F.max("y"), F.max(F.size("features"))).first()
    last, classes, width = shape[0], (shape[1] or 0) + 1, max(shape[2] or 0, 0) + 1
    per_round = max(1, round_values // (block_rows * width))
    block = F.greatest(F.floor((F.col("pos") - warm) / block_rows), F.lit(-1)).cast("long")
    kept = stream.filter(F.col("stream_id").isNotNull()).select(
        "stream_id", "pos", "y", F.concat(F.array(F.lit(1.0)), "features").alias("x"), block.alias("block"),
        F.floor(block / per_round).cast("long").alias("part"),
    )
    # Stored by round, so that a round reads its own rows only.
    kept.repartition("part", "stream_id").write.partitionBy("part").parquet(path)
    rows = spark.read.schema(kept.schema).parquet(path)
    stream_type = stream.schema["stream_id"].dataType.simpleString()
    schema = f"stream_id {stream_type}, block long, w array<array<double>>"
    nested = pa.list_(pa.list_(pa.float64()))
    # The row without a block is the state that the next round starts from.
    rows.select("stream_id").distinct().select(
        "stream_id", F.lit(None).cast("long").alias("block"),
        F.array_repeat(F.array_repeat(F.lit(0.0), width), classes).alias("w"),
    ).write.parquet(f"{rounds}/round=0")

    def walk(steps: int):
        def learn(key: tuple, rows: pa.Table, states: pa.Table) -> pa.Table:
            w = states.column("w")[0].as_py()
            w = None if w is None else np.array(w, dtype=float)
            blocks, before = [], []
            if rows.num_rows:
                pos, at, y = (rows.column(c).to_numpy() for c in ("pos", "block", "y"))
                features = [rows.column(f"x{j}") for j in range(width)]
                x = np.column_stack([c.to_numpy() for c in features])
                # A row that lacks a feature has no score and is not learnt from.
                whole = ~np.any([c.is_null().to_numpy() for c in features], axis=0)
                order = np.lexsort((pos, at))
                starts = np.flatnonzero(np.diff(at[order], prepend=at[order[0]] - 1))
                for mine in np.split(order, starts[1:]):
                    blocks.append(int(at[mine[0]]))
                    before.append(None if w is None else w.tolist())
                    mine = mine[whole[mine]]
                    for _ in range(steps):
                        w = _step(w, x[mine], y[mine], rate)
            after = None if w is None else w.tolist()
            return pa.table({
                "stream_id": pa.repeat(key[0], len(blocks) + 1), "block": pa.array([*blocks, None], pa.int64()),
                "w": pa.array([*before, after], nested),
            })

        return learn

    parts = -1 if last is None or last < warm else (last - warm) // block_rows // per_round
    values = [F.get("x", F.lit(j)).alias(f"x{j}") for j in range(width)]
    for done, part in enumerate(range(-1, parts + 1)):
        state = spark.read.schema(schema).parquet(f"{rounds}/round={done}").filter(F.col("block").isNull())
        mine = rows.filter(F.col("part") == part).select("stream_id", "pos", "block", "y", *values)
        moved = by_group(mine, "stream_id").groupBy("stream_id").cogroup(by_group(state, "stream_id").groupBy("stream_id"))
        moved.applyInArrow(walk(warm_steps if part < 0 else 1), schema).write.parquet(f"{rounds}/round={done + 1}")
    known = spark.read.schema(schema).parquet(*[f"{rounds}/round={i}" for i in range(parts + 3)])
    score = F.transform(
        "w", lambda w: F.aggregate(F.zip_with(w, F.col("x"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    )
    scored = rows.filter(F.col("block") >= 0).join(known, ["stream_id", "block"]).withColumn("score", score)
    best = (F.array_position("score", F.array_max("score")) - 1).cast("int")
    return scored.select("stream_id", "pos", best.alias("predicted"), "y").select(
        "stream_id", "pos", "predicted", (F.col("predicted") == F.col("y")).cast("int").alias("correct")
    )


def compare_policies(traces: DataFrame, baseline: str = "static", versions: DataFrame | None = None) -> DataFrame:
    """Mean accuracy, versions after the first, and gain over the baseline in percent.

    ``traces`` has (stream_id, strategy, fit_pos, correct); fit_pos may be NULL. Refits are
    counted in ``versions`` (stream_id, strategy, fit_pos), or in the traces without it,
    which miss a version that scored no row.
    """
    keys = ["stream_id", "strategy"]
    refit = F.count_distinct(F.when(F.col("fit_pos") > 0, F.col("fit_pos"))).alias("retrains")
    means = traces.groupBy(*keys).agg(F.avg("correct").alias("accuracy"), refit)
    if versions is not None:
        counted = versions.groupBy(*keys).agg(refit)
        means = means.drop("retrains").join(counted, keys, "left").fillna(0, ["retrains"])
    base = means.filter(F.col("strategy") == baseline).select("stream_id", F.col("accuracy").alias("__base"))
    gain = 100.0 * (F.col("accuracy") - F.col("__base")) / F.nullif(F.col("__base"), F.lit(0.0))
    return means.join(base, "stream_id", "left").withColumn("gain_pct", gain).drop("__base")
