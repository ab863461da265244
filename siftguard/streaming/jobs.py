"""Structured Streaming twins of the user-day, profile and drift operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftguard.functions.ks import critical_gap, window_gaps
from siftguard.operators.drift import KsRule
from siftguard.operators.user_days import after_hours, has_external_recipient, on_weekend
from siftguard.session import scratch_path


def run_available(stream: DataFrame, name: str, checkpoint: str | None = None, target: str | None = None) -> str:
    """Process what is there and stop; append to Parquet in the shared folder."""
    spark = stream.sparkSession
    target = target or scratch_path(spark, f"{name}-out")
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint or scratch_path(spark, f"{name}-checkpoint"))
        .option("path", target)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return target


def stream_user_day_features(audit: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Daily features per user from one stream of audit rows.

    ``audit`` has (log, ts, user, pc, activity, filename, to, cc, bcc, size). A day is
    final when the watermark has passed its end. Distinct PCs are approximate, as
    exact distinct counts need unbounded state.
    """
    ts, log = F.col("ts"), F.col("log")

    def total(cond: Column) -> Column:
        return F.sum(F.coalesce(cond.cast("double"), F.lit(0.0)))

    logon = (log == "logon") & (F.col("activity") == "Logon")
    connect = (log == "device") & (F.col("activity") == "Connect")
    archive = F.lower("filename").rlike(r"\.(exe|zip|rar|7z)\z")
    # A day with disconnects only makes no row.
    kept = audit.filter((log != "device") | (F.col("activity") == "Connect"))
    daily = kept.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day"), "user").agg(
        total(logon).alias("logons"),
        total(logon & after_hours(ts)).alias("logon_afterhours"),
        total(logon & on_weekend(ts)).alias("logon_weekend"),
        F.approx_count_distinct(F.when(log == "logon", F.col("pc"))).cast("double").alias("n_pc"),
        total(connect).alias("usb_connects"),
        total(connect & after_hours(ts)).alias("usb_afterhours"),
        total(log == "file").alias("file_copies"),
        total((log == "file") & archive).alias("file_exe_zip"),
        total(log == "email").alias("emails"),
        total((log == "email") & has_external_recipient()).alias("email_external"),
        F.sum(F.when(log == "email", F.coalesce(F.col("size").try_cast("double"), F.lit(0.0))).otherwise(0.0)).alias(
            "email_bytes"
        ),
    )
    return daily.select("user", F.to_date("window.start").alias("date"), *daily.columns[2:])


def stream_profile_scores(days: DataFrame, rho: float, warmup: int, features: list[str]) -> DataFrame:
    """Exceedances per user-day, online: the state is the warm-up rows, then mean and variance.

    ``days`` has (user, day, features) with days in order per user over the
    micro-batches. A day that was already seen is dropped.
    """
    names = [f"z_{f}" for f in features]

    def update(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, held, mean, spread = state.get if state.exists else (-1, [], [], [])
        # A few days of one user: plain arrays cost far less here than frames.
        parts = [(c["day"].to_numpy(), np.column_stack([c[f].to_numpy(dtype=float) for f in features])) for c in chunks]
        days, x = (np.concatenate(p) for p in zip(*parts))
        days, first = np.unique(days, return_index=True)
        x = x[first][days > seen]
        days = days[days > seen]
        z = np.zeros_like(x)
        held = list(held)
        mean, spread = np.asarray(mean, dtype=float), np.asarray(spread, dtype=float)
        for i, today in enumerate(x):
            if not len(mean):
                held += today.tolist()
                if len(held) == warmup * len(features):
                    first = np.asarray(held).reshape(warmup, -1)
                    mean, spread = first.mean(0), first.var(0) + 1e-6
                    held = []
                continue
            z[i] = np.maximum((today - mean) / np.sqrt(spread), 0.0)
            mean = rho * mean + (1.0 - rho) * today
            spread = rho * spread + (1.0 - rho) * np.square(today - mean) + 1e-9
        if len(days):
            seen = int(days[-1])
        state.update((seen, [float(v) for v in held], mean.tolist(), spread.tolist()))
        yield pd.DataFrame({"user": np.full(len(days), key[0], dtype=object), "day": days, **dict(zip(names, z.T))})

    return days.groupBy("user").applyInPandasWithState(
        update,
        "user string, day int, " + ", ".join(f"{n} double" for n in names),
        "seen int, held array<double>, mean array<double>, spread array<double>",
        "append",
        GroupStateTimeout.NoTimeout,
    )


class OnlineKs:
    """Confirmed KS detection for one stream with two windows of rows as state."""

    def __init__(self, rule: KsRule, width: int, limit: int, state: tuple | None = None):
        self.rule, self.width, self.limit = rule, width, limit
        if state is None:
            state = (rule.first_start, rule.first_end, 0, 0, [], [])
        self.ref_start, self.next_end, self.run, self.base, ref, recent = state
        self.ref = np.asarray(ref, dtype=float).reshape(-1, width)
        self.recent = np.asarray(recent, dtype=float).reshape(-1, width)

    def _fill_reference(self) -> None:
        have, want = len(self.ref), self.rule.window
        low = self.ref_start + have - self.base
        if have < want and low < len(self.recent):
            self.ref = np.vstack([self.ref, self.recent[max(low, 0): self.ref_start + want - self.base]])

    def feed(self, pos: np.ndarray, x: np.ndarray) -> list[int]:
        """Take rows in order; rows before the expected position are late and dropped."""
        expected = self.base + len(self.recent)
        self.recent = np.vstack([self.recent, x[pos >= expected]])
        alarms = []
        self._fill_reference()
        while self.next_end <= self.base + len(self.recent) and len(self.ref) == self.rule.window:
            end = self.next_end - self.base
            window = self.recent[end - self.rule.window: end]
            gap = max(
                int(window_gaps(np.sort(self.ref[:, f]), window[None, :, f])[0]) for f in range(self.width)
            )
            self.run = self.run + 1 if gap >= self.limit else 0
            if self.run >= self.rule.confirm:
                alarms.append(self.next_end)
                self.ref_start, self.ref, self.run = self.next_end, self.ref[:0], 0
                self.next_end += self.rule.resume_offset
                self._fill_reference()
            else:
                self.next_end += self.rule.step
        needed = self.next_end - self.rule.window
        if len(self.ref) < self.rule.window:
            needed = min(needed, self.ref_start + len(self.ref))
        drop = int(np.clip(needed - self.base, 0, len(self.recent)))
        self.recent, self.base = self.recent[drop:], self.base + drop
        return alarms

    def state(self) -> tuple:
        return (
            int(self.ref_start), int(self.next_end), int(self.run), int(self.base),
            self.ref.ravel().tolist(), self.recent.ravel().tolist(),
        )


def stream_ks_drift(stream: DataFrame, rule: KsRule, width: int) -> DataFrame:
    """Alarms of the confirmed detector, online; needs a rule whose reference follows the alarm.

    Positions of a stream arrive in order over the micro-batches.
    """
    limit = critical_gap(rule.window, rule.window, rule.alpha / width)
    stream_type = stream.schema["stream_id"].dataType.simpleString()

    def update(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        detector = OnlineKs(rule, width, limit, tuple(state.get) if state.exists else None)
        rows = pd.concat(list(chunks)).drop_duplicates("pos").sort_values("pos")
        alarms = detector.feed(rows["pos"].to_numpy(), np.stack(rows["features"].to_numpy()))
        state.update(detector.state())
        if alarms:
            yield pd.DataFrame({"stream_id": [key[0]] * len(alarms), "alarm_pos": alarms})

    return stream.groupBy("stream_id").applyInPandasWithState(
        update,
        f"stream_id {stream_type}, alarm_pos long",
        "ref_start long, next_end long, run int, base long, ref array<double>, recent array<double>",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def replay(spark: SparkSession, table: DataFrame, split: Column, parts: int, build, name: str) -> DataFrame:
    """Feed a table to a streaming job in ``parts`` ordered micro-batches.

    ``split`` numbers the parts from 0. Each part is appended to the input folder and
    the job run again from its checkpoint, as a scheduled job would.
    """
    source = scratch_path(spark, f"{name}-in")
    checkpoint = scratch_path(spark, f"{name}-checkpoint")
    target = scratch_path(spark, f"{name}-out")
    schema = None
    for part in range(parts):
        table.filter(split == part).write.mode("append").parquet(source)
        stream = build(spark.readStream.schema(table.schema).parquet(source))
        schema = stream.schema
        run_available(stream, name, checkpoint, target)
    return spark.read.schema(schema).parquet(target)
