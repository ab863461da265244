"""Detectors on the 0/1 error of a classifier: ADWIN, DDM, EDDM and KSWIN.

Written from the published descriptions (Bifet and Gavalda 2007; Gama et al. 2004;
Baena-Garcia et al. 2006; Raab et al. 2020). Each keeps a small state per stream, far
smaller than the rows it has seen.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftguard.functions.ks import critical_gap, window_gaps
from siftguard.operators.running import running
from siftguard.session import by_group, scratch_path


@dataclass
class Ddm:
    """Alarm when the error rate plus deviation leaves its minimum by three deviations."""

    n: int = 0
    errors: int = 0
    low_rate: float = float("inf")
    low_dev: float = float("inf")
    warm: int = 30
    level: float = 3.0

    def update(self, error: int) -> bool:
        self.n += 1
        self.errors += error
        rate = self.errors / self.n
        dev = sqrt(rate * (1.0 - rate) / self.n)
        if self.n < self.warm:
            return False
        if rate + dev <= self.low_rate + self.low_dev:
            self.low_rate, self.low_dev = rate, dev
        if rate + dev > self.low_rate + self.level * self.low_dev:
            self.n, self.errors = 0, 0
            self.low_rate = self.low_dev = float("inf")
            return True
        return False


@dataclass
class Eddm:
    """Alarm when the distance between errors shrinks below a share of its maximum."""

    n: int = 0
    errors: int = 0
    last_error: int = 0
    mean: float = 0.0
    m2: float = 0.0
    peak: float = 0.0
    warm: int = 30
    beta: float = 0.9

    def update(self, error: int) -> bool:
        self.n += 1
        if not error:
            return False
        self.errors += 1
        distance = self.n - self.last_error
        self.last_error = self.n
        shift = distance - self.mean
        self.mean += shift / self.errors
        self.m2 += shift * (distance - self.mean)
        spread = self.mean + 2.0 * sqrt(self.m2 / self.errors)
        if self.n < self.warm:
            return False
        if spread > self.peak:
            self.peak = spread
            return False
        if self.errors >= self.warm and spread / self.peak < self.beta:
            self.n = self.errors = self.last_error = 0
            self.mean = self.m2 = self.peak = 0.0
            return True
        return False


@dataclass
class Adwin:
    """Adaptive window: drop the oldest part while two parts differ in mean.

    The window is kept as buckets (size, sum, squared deviation), newest first; at
    most ``per_size`` buckets of a size, then the two oldest of it are merged.
    """

    buckets: list[list[float]] = field(default_factory=list)
    seen: int = 0
    delta: float = 0.002
    clock: int = 32
    per_size: int = 5
    least: int = 5
    grace: int = 10

    def _compress(self) -> None:
        size, start = 1, 0
        while True:
            end = start
            while end < len(self.buckets) and self.buckets[end][0] == size:
                end += 1
            if end - start <= self.per_size:
                return
            (n1, s1, d1), (n2, s2, d2) = self.buckets[end - 2], self.buckets[end - 1]
            gap = s1 / n1 - s2 / n2
            merged = [n1 + n2, s1 + s2, d1 + d2 + n1 * n2 / (n1 + n2) * gap * gap]
            self.buckets[end - 2: end] = [merged]
            start, size = end - 2, size * 2

    def _totals(self) -> tuple[float, float, float]:
        n = s = d = 0.0
        for bn, bs, bd in self.buckets:
            if n:
                gap = s / n - bs / bn
                d += bd + n * bn / (n + bn) * gap * gap
            else:
                d = bd
            n, s = n + bn, s + bs
        return n, s, d

    def _splits(self) -> bool:
        n, s, d = self._totals()
        if n < self.grace:
            return False
        variance = d / n
        confidence = 2.0 * log(2.0 * log(n) / self.delta)
        old_n = old_s = 0.0
        for bn, bs, _ in reversed(self.buckets):
            old_n, old_s = old_n + bn, old_s + bs
            new_n = n - old_n
            if new_n < self.least:
                return False
            if old_n < self.least:
                continue
            inverse = 1.0 / (old_n - self.least + 1) + 1.0 / (new_n - self.least + 1)
            cut = sqrt(confidence * variance * inverse) + confidence / 3.0 * inverse
            if abs(old_s / old_n - (s - old_s) / new_n) > cut:
                return True
        return False

    def update(self, error: int) -> bool:
        self.seen += 1
        self.buckets.insert(0, [1, float(error), 0.0])
        self._compress()
        alarm = False
        if self.seen % self.clock == 0:
            while self.buckets and self._splits():
                self.buckets.pop()
                alarm = True
        return alarm


@dataclass
class Kswin:
    """KS test of the newest values against a sample of the older ones in the window.

    The sample is drawn by a counter-based rule, so a rerun gives the same alarms. As long as
    all values are 0 or 1, the gap is the difference of two counts of ones: where no sample of
    the older values can reach the limit, none is drawn, and the counter goes on all the same.
    """

    values: list[float] = field(default_factory=list)
    drawn: int = 0
    size: int = 100
    recent: int = 30
    alpha: float = 0.005
    seed: int = 0
    binary: bool = True

    def update(self, error: int) -> bool:
        self.values.append(float(error))
        self.binary = self.binary and error in (0, 1)
        if len(self.values) < self.size:
            return False
        del self.values[: len(self.values) - self.size]
        self.drawn += 1
        limit = critical_gap(self.recent, self.recent, self.alpha)
        if self.binary:
            ones, mine = sum(self.values[: -self.recent]), sum(self.values[-self.recent:])
            least, most = max(0, ones + 2 * self.recent - self.size), min(self.recent, ones)
            if self.recent * max(most - mine, mine - least) < limit:
                return False
        window = np.asarray(self.values)
        old, new = window[: -self.recent], window[-self.recent:]
        rng = np.random.default_rng([self.seed, self.drawn])
        sample = rng.choice(old, self.recent, replace=False)
        if self.binary:
            gap = int(self.recent * abs(sample.sum() - mine))
        else:
            gap = int(window_gaps(np.sort(sample), new[None, :])[0])
        if gap >= limit and gap / self.recent**2 > 0.1:
            self.values = list(new)
            return True
        return False


KINDS = {"adwin": Adwin, "ddm": Ddm, "eddm": Eddm, "kswin": Kswin}


def fresh_state(kind: str) -> str:
    return json.dumps(asdict(KINDS[kind]()))


def advance(kind: str, state: str, positions: np.ndarray, errors: np.ndarray) -> tuple[list[int], str]:
    """Feed ordered errors to one detector; its alarms and the new state."""
    detector = KINDS[kind](**json.loads(state))
    alarms = [p for p, e in zip(positions.tolist(), errors.tolist()) if detector.update(e)]
    return alarms, json.dumps(asdict(detector))


def error_stream_detectors(
    trace: DataFrame,
    kinds: list[str] | None = None,
    warm: int = 200,
    block: int = 500_000,
) -> DataFrame:
    """Alarms (stream_id, kind, alarm_pos) on a correctness trace (stream_id, pos, correct).

    The detectors are sequential per stream. Streams and detectors run side by side,
    and all of them block by block: a task gets one block of a stream and the small
    state after the block before, so a long stream never meets in one task, and a
    lost executor costs one block.
    """
    spark = trace.sparkSession
    kinds = kinds or list(KINDS)
    # Stored by block, so that a round reads its own rows only.
    path = scratch_path(spark, "trace")
    kept = trace.filter(F.col("pos") >= warm).select(
        "stream_id", "pos", (1 - F.col("correct")).cast("int").alias("error"),
        F.floor((F.col("pos") - warm) / block).cast("long").alias("block"),
    )
    kept.repartition("block", "stream_id").write.partitionBy("block").parquet(path)
    rows = spark.read.schema(kept.schema).parquet(path)
    stream_type = trace.schema["stream_id"].dataType.simpleString()
    schema = f"stream_id {stream_type}, kind string, alarms array<long>, state string"
    rounds = scratch_path(spark, "error-rounds")
    each_kind = F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind")
    fresh = F.element_at(
        F.create_map(*[c for k in kinds for c in (F.lit(k), F.lit(fresh_state(k)))]), F.col("kind")
    )
    rows.select("stream_id").distinct().select("stream_id", each_kind).select(
        "stream_id", "kind", F.array().cast("array<bigint>").alias("alarms"), fresh.alias("state")
    ).write.parquet(f"{rounds}/round=0")
    last = rows.agg(F.max("pos")).first()[0]
    blocks = 0 if last is None else (last - warm) // block + 1

    def step(key: tuple, errors: pa.Table, states: pa.Table) -> pa.Table:
        errors = errors.sort_by("pos")
        alarms, after = advance(
            key[1].as_py(), states.column("state")[0].as_py(), errors.column("pos").to_numpy(), errors.column("error").to_numpy()
        )
        return pa.table({
            "stream_id": pa.repeat(key[0], 1), "kind": pa.repeat(key[1], 1),
            "alarms": pa.array([alarms], pa.list_(pa.int64())), "state": [after],
        })

    keys = ("stream_id", "kind")
    for b in range(blocks):
        part = rows.filter(F.col("block") == b).drop("block").select("*", each_kind)
        state = spark.read.schema(schema).parquet(f"{rounds}/round={b}")
        moved = by_group(part, *keys).groupBy(*keys).cogroup(by_group(state, *keys).groupBy(*keys))
        moved.applyInArrow(step, schema).write.parquet(f"{rounds}/round={b + 1}")
    every = spark.read.schema(schema).parquet(*[f"{rounds}/round={b}" for b in range(blocks + 1)])
    return every.select("stream_id", "kind", F.explode("alarms").alias("alarm_pos"))


def ddm_first_alarm(trace: DataFrame, warm: int = 30, level: float = 3.0, block: int = 100_000) -> DataFrame:
    """First DDM alarm per stream by running sums alone.

    The minimum of rate + deviation is found as a running maximum of its negative,
    which carries the rate and the deviation along.
    """
    bucket = F.floor(F.col("pos") / block)
    counted = running(
        trace, ["stream_id"], bucket, ["pos"],
        {"n": ("sum", F.lit(1).cast("long")), "errors": ("sum", (1 - F.col("correct")).cast("long"))},
    )
    rate = F.col("errors") / F.col("n")
    rated = counted.withColumn("rate", rate).withColumn(
        "dev", F.sqrt(F.col("rate") * (1.0 - F.col("rate")) / F.col("n"))
    ).filter(F.col("n") >= warm)
    # Largest (-(rate + dev), pos): the minimum, the latest position on ties.
    point = F.struct((-(F.col("rate") + F.col("dev"))).alias("s"), "pos", "rate", "dev")
    lows = running(rated, ["stream_id"], bucket, ["pos"], {"low": ("max", point)})
    alarm = F.col("rate") + F.col("dev") > F.col("low.rate") + level * F.col("low.dev")
    return lows.filter(alarm).groupBy("stream_id").agg(F.min("pos").alias("alarm_pos"))
