"""Drift detection by KS tests on sliding windows, and alarm scoring.

A stream is a table (stream_id, pos, features array<double>), pos 0, 1, 2, ... One
stream may hold most of the rows. Windows are therefore tested in blocks of
positions; a block's rows and one reference window meet in a task, never a stream.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftguard.functions.ks import critical_gap, window_gaps
from siftguard.operators.running import quantile_bucket, running
from siftguard.session import by_group, materialize, scratch_path


def standardize_prefix(stream: DataFrame, warm: int) -> DataFrame:
    """z-values by mean and population deviation of the first ``warm`` rows."""
    numbered = stream.filter(F.col("pos") < warm).select("stream_id", F.posexplode("features").alias("f", "v"))
    stats = numbered.groupBy("stream_id", "f").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"))
    packed = stats.groupBy("stream_id").agg(
        F.array_sort(
            F.collect_list(F.struct("f", "mu", F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")).alias("sd")))
        ).alias("__s")
    )
    scaled = F.zip_with("features", "__s", lambda v, s: (v - s["mu"]) / s["sd"])
    return stream.join(packed, "stream_id").withColumn("features", scaled).drop("__s")


def sliding_samples(stream: DataFrame, window: int, step: int, first_end: int) -> DataFrame:
    """Rows with the ids of all complete windows they belong to.

    Window j holds the ``window`` rows before position ``first_end + j * step``; a row
    is copied to about ``window / step`` windows.
    """
    lengths = stream.groupBy("stream_id").agg((F.max("pos") + 1).alias("__n"))
    pos = F.col("pos")
    low = F.greatest(F.ceil((pos + 1 - first_end) / step), F.lit(0)).cast("long")
    high = F.least(
        F.floor((pos + window - first_end) / step), F.floor((F.col("__n") - first_end) / step)
    ).cast("long")
    ids = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    return stream.join(lengths, "stream_id").select(
        "stream_id", "pos", "features", F.explode(ids).alias("window_id")
    )


def ks_statistic(rows: DataFrame, keys: list[str], value: str, in_first: Column) -> DataFrame:
    """Distance of two labelled samples per key, for samples of any size.

    Equal values are merged before the shuffle; the running counts are cut into value
    ranges, so a key with most of the rows is shared by many tasks.
    """
    counts = rows.groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(
        F.count_if(in_first).alias("a"), F.count_if(~in_first).alias("b")
    )
    counts = counts.persist(StorageLevel.MEMORY_AND_DISK)
    ranges = quantile_bucket(counts, "__v")
    steps = running(counts, keys, ranges, ["__v"], {"ca": ("sum", F.col("a")), "cb": ("sum", F.col("b"))})
    sizes = counts.groupBy(*keys).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    gap = F.abs(F.col("ca") / F.col("n1") - F.col("cb") / F.col("n2"))
    return (
        steps.join(sizes.filter((F.col("n1") > 0) & (F.col("n2") > 0)), keys)
        .groupBy(*keys)
        .agg(F.max("n1").alias("n1"), F.max("n2").alias("n2"), F.max(gap).alias("distance"))
    )


@dataclass(frozen=True)
class KsRule:
    """How windows are taken, when they alarm, and what happens after an alarm at ``a``.

    The next reference is ``[a + reference_offset, ... + window)``; the next window ends
    at ``a + resume_offset``. The first reference is ``[first_start, first_start +
    first_size)``, the first window ends at ``first_end``. ``closing`` is 0 if a window
    may end with the last row of the stream, 1 if there must be a row after it.
    """

    window: int = 300
    step: int = 50
    alpha: float = 0.05
    confirm: int = 3
    reference_offset: int = 0
    resume_offset: int = 600
    first_start: int = 0
    first_size: int = 300
    first_end: int = 600
    closing: int = 0


def confirmed_rule(window: int = 300, step: int = 50, alpha: float = 0.05, confirm: int = 3) -> KsRule:
    """The next reference is the window that follows the alarm."""
    return KsRule(
        window, step, alpha, confirm,
        reference_offset=0, resume_offset=2 * window,
        first_start=0, first_size=window, first_end=2 * window,
    )


def trailing_rule(warm: int, window: int, alpha: float = 0.05, confirm: int = 3) -> KsRule:
    """The first reference is the whole warm prefix, later ones the alarming window."""
    step = max(50, window // 4)
    return KsRule(
        window, step, alpha, confirm,
        reference_offset=-window, resume_offset=step,
        first_start=0, first_size=warm, first_end=max(warm + step, window), closing=1,
    )


def exploring_rule(
    warm: int, window: int = 250, step: int = 50, alpha: float = 0.02, confirm: int = 2,
    last_refit: int = 600, rest: int = 400,
) -> KsRule:
    """Detection rests during a series of refits and takes its reference at the last one."""
    pause = -(-(last_refit + rest) // step) * step
    return KsRule(
        window, step, alpha, confirm,
        reference_offset=last_refit - window, resume_offset=pause,
        first_start=warm - window, first_size=window,
        first_end=warm + -(-window // step) * step, closing=1,
    )


def _gaps(x: np.ndarray, ref: np.ndarray, ends: np.ndarray, rule: KsRule) -> np.ndarray:
    """Largest gap over the features per window end; row 0 of ``x`` is position 0 of ``ends``."""
    rows = ends[:, None] + np.arange(-rule.window, 0)[None, :]
    by_feature = [window_gaps(np.sort(ref[:, f]), x[rows, f]) for f in range(x.shape[1])]
    return np.max(by_feature, axis=0)


def critical_gaps(stream: DataFrame, rule: KsRule) -> dict[int, int]:
    """Critical gap per reference size, the level shared by the features.

    Computed once on the driver; tasks get two numbers.
    """
    row = stream.select(F.size("features")).first()
    m = row[0] if row else 1
    return {n: critical_gap(n, rule.window, rule.alpha / m) for n in {rule.first_size, rule.window}}


def _first_confirmed(hit: np.ndarray, confirm: int, skip: int, run: int = 0) -> tuple[int | None, int]:
    """Index of the first confirmed signal at or after ``skip``, and the run at the end."""
    for i, h in enumerate(hit):
        run = run + 1 if h else 0
        if run >= confirm and i >= skip:
            return i, 0
    return None, run


# Windows tested in one step inside a task; bounds the memory of the kernel. After an alarm
# steps start small, so that little is tested that the next alarm makes void.
_CHUNK, _FIRST_CHUNK = 512, 16


def scan_block(
    pos: np.ndarray,
    x: np.ndarray,
    first: int,
    last: int,
    ref_start: int,
    ref_size: int,
    origin: int,
    rule: KsRule,
    limits: dict[int, int],
    known: frozenset[int] = frozenset(),
) -> tuple[list[int], int, int, int, int]:
    """Run the detector over window ends ``first, first + step, ... <= last``.

    ``pos`` is sorted. Up to ``confirm - 1`` earlier ends, not before ``origin``, are
    looked at again to know the current run of signals. Returns the alarms and the
    state to go on with: reference start and size, next end, origin. Ends early at an
    alarm of ``known``, from which the rest follows.
    """
    def rows(lo: int, hi: int) -> np.ndarray:
        at = np.searchsorted(pos, [lo, hi])
        return x[at[0]: at[1]]

    alarms: list[int] = []
    reference = rows(ref_start, ref_start + ref_size)
    while first <= last:
        back = min(rule.confirm - 1, max(0, (first - origin) // rule.step))
        start = first - back * rule.step
        found, run, chunk = None, 0, _FIRST_CHUNK
        while start <= last and found is None:
            ends = np.arange(start, min(last, start + (chunk - 1) * rule.step) + 1, rule.step)
            chunk = min(2 * chunk, _CHUNK)
            base = int(ends[0]) - rule.window
            gaps = _gaps(rows(base, int(ends[-1])), reference, ends - base, rule)
            hit = gaps >= limits[ref_size]
            at, run = _first_confirmed(hit, rule.confirm, max(0, (first - start) // rule.step), run)
            found = None if at is None else int(ends[at])
            start = int(ends[-1]) + rule.step
            first = max(first, start) if found is None else first
        if found is None:
            break
        alarms.append(found)
        ref_start, ref_size = found + rule.reference_offset, rule.window
        first = origin = found + rule.resume_offset
        if found in known:
            break
        if first <= last:
            reference = rows(ref_start, ref_start + ref_size)
    return alarms, ref_start, ref_size, first, origin


_ENTRY = ("ref_start", "ref_size", "next_end", "origin")
_EXIT = tuple(f"out_{c}" for c in _ENTRY)
_LONGS = ("block", "last", "frontier", *_ENTRY, *_EXIT)
# Rows of a stream that are looked up together.
_CELL = 1_000


def _entries(runs: pa.Table, first_end: int, span: int, step: int, every: bool) -> list[dict]:
    """Blocks of one stream whose entry is not the one they were run from, with the entry to take.

    A block that was run from another state is taken to end as it did then, or, if it had no
    alarm, to hand the new state on. Up to the first such block, the frontier, all is certain.
    Without ``every`` only twice as many blocks are taken as the frontier moved on.
    """
    runs = sorted(runs.to_pylist(), key=lambda r: r["block"])
    state, wanted = None, []
    for r in runs:
        entry, after = tuple(r[c] for c in _ENTRY), tuple(r[c] for c in _EXIT)
        if state is None or state == entry:
            state = after
            continue
        wanted.append({"stream_id": r["stream_id"], "block": r["block"], **dict(zip(_ENTRY, state))})
        if r["n"]:
            state = after
        else:
            ref_start, ref_size, next_end, origin = state
            behind = min(r["last"], first_end + (r["block"] + 1) * span - 1) - next_end
            state = ref_start, ref_size, next_end + max(0, behind // step + 1) * step, origin
    if not wanted:
        return []
    frontier = wanted[0]["block"]
    ahead = len(runs) if every else 2 * max(1, frontier - max(r["frontier"] for r in runs))
    return [{**w, "frontier": frontier} for w in wanted if w["block"] < frontier + ahead]


def ks_confirm_detector(
    stream: DataFrame, rule: KsRule, block_windows: int = 20_000, name: str = "ks"
) -> DataFrame:
    """Alarm positions (stream_id, alarm_pos) of every stream.

    What follows an alarm depends on its position alone. So all blocks of a stream are run
    side by side, each from a guessed state, as if an alarm had come in time for its first
    window. Then a block whose entry is not what the block before it ended with is run again
    from there, until it meets an alarm of its former run; the rest of that run holds. A
    block without alarms hands its state on. Rounds end when all entries fit, so the alarms
    are those of the plain sequence. Each round settles one more block at least, mostly all:
    the blocks of a round are bounded by those that the round before settled. The state is
    one small row per block in the shared folder.
    """
    spark = stream.sparkSession
    named = stream.filter(F.col("stream_id").isNotNull())
    rows = materialize(named.select("stream_id", "pos", "features"), f"{name}-rows")
    limits = critical_gaps(rows, rule)
    span = block_windows * rule.step
    stream_type = stream.schema["stream_id"].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in _LONGS)
    schema = f"stream_id {stream_type}, {longs}, alarms array<long>"
    rounds = scratch_path(spark, f"{name}-rounds")

    def scan(key: tuple, block: pa.Table, tasks: pa.Table) -> pa.Table:
        t = tasks.to_pylist()[0]
        end = min(t["last"], rule.first_end + (t["block"] + 1) * span - 1)
        known, alarms, after = t["alarms"] or [], [], [t[c] for c in _ENTRY]
        if block.num_rows and t["next_end"] <= end:
            pos, x = ordered_rows(block)
            alarms, *after = scan_block(
                pos, x, t["next_end"], end, t["ref_start"], t["ref_size"], t["origin"], rule, limits, frozenset(known)
            )
            if alarms and alarms[-1] in known:
                alarms, after = alarms + [a for a in known if a > alarms[-1]], [t[c] for c in _EXIT]
        row = {**t, **dict(zip(_EXIT, after))}
        out = {c: pa.array([row[c]], pa.int64()) for c in _LONGS}
        return pa.table({
            "stream_id": pa.repeat(key[0], 1), **out, "alarms": pa.array([alarms], pa.list_(pa.int64())),
        })

    def entries(every: bool):
        def resolve(key: tuple, runs: pa.Table) -> pa.Table:
            wanted = _entries(runs, rule.first_end, span, rule.step, every)
            out = {c: pa.array([w[c] for w in wanted], pa.int64()) for c in ("block", "frontier", *_ENTRY)}
            return pa.table({"stream_id": pa.repeat(key[0], len(wanted)), **out})

        return resolve

    zero = F.lit(0).cast("long")
    block = F.explode(F.sequence(zero, F.floor((F.col("last") - rule.first_end) / span).cast("long"))).alias("block")
    lengths = rows.groupBy("stream_id").agg((F.max("pos") + 1 - rule.closing).alias("last"))
    low = rule.first_end + F.col("block") * span
    guess = {
        "ref_start": (rule.first_start, low - rule.resume_offset + rule.reference_offset),
        "ref_size": (rule.first_size, F.lit(rule.window)), "next_end": (rule.first_end, low), "origin": (rule.first_end, low),
    }
    tasks = lengths.filter(F.col("last") >= rule.first_end).select("stream_id", "last", block).withColumns({
        "frontier": zero, "alarms": F.array().cast("array<bigint>"),
        **{c: F.when(F.col("block") == 0, F.lit(a)).otherwise(b).cast("long") for c, (a, b) in guess.items()},
        **{c: zero for c in _EXIT},
    })
    done = 0
    while True:
        tasks = materialize(tasks.select("stream_id", *_LONGS, "alarms"), f"{name}-tasks")
        if tasks.isEmpty():
            break
        end = F.least(F.col("last"), rule.first_end + (F.col("block") + 1) * span - 1)
        # Earlier windows that tell the current run of signals need rows before the block.
        reach = F.greatest("origin", F.col("next_end") - (rule.confirm - 1) * rule.step) - rule.window
        ranges = tasks.withColumns({"end": end, "low": reach}).filter(F.col("next_end") <= F.col("end"))
        cells = F.array_union(
            _cells(F.col("low"), F.col("end"), _CELL),
            _cells(F.col("ref_start"), F.col("ref_start") + F.col("ref_size"), _CELL),
        )
        placed = ranges.select("stream_id", F.explode(cells).alias("cell"), "block", "low", "end", "ref_start", "ref_size")
        wanted = ((F.col("pos") >= F.col("low")) & (F.col("pos") < F.col("end"))) | (
            (F.col("pos") >= F.col("ref_start")) & (F.col("pos") < F.col("ref_start") + F.col("ref_size"))
        )
        needed = rows.withColumn("cell", F.floor(F.col("pos") / _CELL).cast("long")).join(
            placed, ["stream_id", "cell"]
        ).filter(wanted).select("stream_id", "block", "pos", "features")
        runs = _per_block(needed, tasks.select(*[F.col(c).alias(c) for c in tasks.columns]), ["stream_id", "block"])
        runs.applyInArrow(scan, schema).write.parquet(f"{rounds}/round={done}")
        done += 1
        every = None
        for i in range(done):
            part = spark.read.schema(schema).parquet(f"{rounds}/round={i}").withColumn("round", F.lit(i))
            every = part if every is None else every.unionByName(part)
        columns = [c for c in every.columns if c not in ("stream_id", "block", "round")]
        latest = every.groupBy("stream_id", "block").agg(F.max_by(F.struct(*columns), "round").alias("r")).select(
            "stream_id", "block", "r.*"
        )
        ends = latest.select("stream_id", *_LONGS, F.size("alarms").alias("n"))
        moved = by_group(ends, "stream_id").groupBy("stream_id").applyInArrow(
            entries(done == 1), f"stream_id {stream_type}, " + ", ".join(f"{c} long" for c in ("block", "frontier", *_ENTRY))
        )
        tasks = moved.join(
            latest.select("stream_id", "block", "last", *_EXIT, "alarms"), ["stream_id", "block"]
        )
    if not done:
        return spark.createDataFrame([], f"stream_id {stream_type}, alarm_pos long")
    return latest.select("stream_id", F.explode("alarms").alias("alarm_pos"))


def _per_block(rows: DataFrame, parameters: DataFrame, keys: list[str]):
    """Rows of a block next to its parameters."""
    return by_group(rows, *keys).groupBy(*keys).cogroup(by_group(parameters, *keys).groupBy(*keys))


def ordered_rows(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions and the matching feature rows; a position counts once."""
    pos, first = np.unique(block.column("pos").to_numpy(), return_index=True)
    flat = block.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return pos, flat.reshape(block.num_rows, -1)[first]


def _cells(low: Column, end: Column, span: int) -> Column:
    """Storage cells that hold the positions ``low <= pos < end``."""
    return F.sequence(F.floor(low / span).cast("long"), F.floor((end - 1) / span).cast("long"))


def window_signals(stream: DataFrame, rule: KsRule, block_windows: int = 2_000) -> DataFrame:
    """Largest gap and signal of every window against the first reference.

    One shuffle: rows go to their block of windows, and a block that ends in another
    one gets the rows of the overlap, so a row is copied once at most. The reference
    of each stream is one array of ``first_size`` rows.
    """
    limits = critical_gaps(stream, rule)
    span = max(block_windows * rule.step, rule.window)
    lengths = stream.groupBy("stream_id").agg((F.max("pos") + 1 - rule.closing).alias("last"))
    in_reference = (F.col("pos") >= rule.first_start) & (F.col("pos") < rule.first_start + rule.first_size)
    references = (
        stream.filter(in_reference)
        .groupBy("stream_id")
        .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "features"))), lambda r: r["features"])).alias("ref"))
    )
    # A window that ends at e belongs to block (e - first_end) // span.
    last_use = F.floor((F.col("pos") + rule.window - rule.first_end) / span).cast("long")
    first_use = F.floor((F.col("pos") + 1 - rule.first_end) / span).cast("long")
    blocks = F.when(
        last_use >= 0, F.sequence(F.greatest(first_use, F.lit(0).cast("long")), last_use)
    ).otherwise(F.array().cast("array<bigint>"))
    placed = stream.select("stream_id", "pos", "features", F.explode(blocks).alias("block"))
    stream_type = stream.schema["stream_id"].dataType.simpleString()

    schema = f"stream_id {stream_type}, window_id long, gap long, signal boolean"

    def test(key: tuple, block: pa.Table, references: pa.Table) -> pa.Table:
        low = key[1].as_py() * span
        ends = np.zeros(0, dtype=np.int64)
        if block.num_rows and references.num_rows:
            r = references.to_pylist()[0]
            ends = rule.first_end + np.arange(-(-low // rule.step) * rule.step, low + span, rule.step)
            ends = ends[ends <= r["last"]]
        gaps = ends
        if len(ends):
            pos, x = ordered_rows(block)
            ref = np.asarray(r["ref"]).reshape(-1, x.shape[1])
            parts = [ends[c: c + _CHUNK] - pos[0] for c in range(0, len(ends), _CHUNK)]
            gaps = np.concatenate([_gaps(x, ref, part, rule) for part in parts])
        stream_ids = pa.repeat(key[0], len(ends))
        return pa.table(
            {
                "stream_id": stream_ids, "window_id": (ends - rule.first_end) // rule.step,
                "gap": gaps, "signal": gaps >= limits[rule.first_size],
            }
        )

    last_block = F.greatest(F.floor((F.col("last") - rule.first_end) / span).cast("long"), F.lit(0).cast("long"))
    # Aliased columns: both sides of the cogroup come from the same stream.
    reference_rows = references.join(lengths, "stream_id").select(
        F.col("stream_id").alias("stream_id"), "ref", "last",
        F.explode(F.sequence(F.lit(0).cast("long"), last_block)).alias("block"),
    )
    return _per_block(placed, reference_rows, ["stream_id", "block"]).applyInArrow(test, schema)


def consecutive_signals(signals: DataFrame, block: int = 100_000) -> DataFrame:
    """Length of the run of signals that ends at each window; 0 without a signal."""
    quiet = F.when(~F.col("signal"), F.col("window_id"))
    marked = running(
        signals, ["stream_id"], F.floor(F.col("window_id") / block), ["window_id"], {"__quiet": ("max", quiet)}
    )
    return marked.withColumn("run", F.col("window_id") - F.coalesce("__quiet", F.lit(-1))).drop("__quiet")


def score_alarms(
    alarms: DataFrame, change_points: DataFrame, tolerance: Column | int, streams: DataFrame
) -> DataFrame:
    """precision, recall, F1, mean delay and false alarms per stream.

    An alarm is true if it lies in ``[cp, cp + tolerance]``; the earliest listed
    change point takes it (``cp_order``). A change point counts once, with its first
    listed alarm. ``streams`` names the streams, so that silent ones are reported.
    ``change_points`` has (stream_id, cp_order, cp_pos) and may have cp_type.
    """
    limit = tolerance if isinstance(tolerance, Column) else F.lit(tolerance)
    points = change_points.withColumn("tol", limit.cast("long"))
    width = F.greatest(F.col("tol"), F.lit(1))
    # Change points are keyed by (stream, tolerance, bucket), so alarms meet only near ones.
    widths = points.groupBy("stream_id").agg(F.collect_set(width).alias("__widths"))
    near_points = points.withColumn("__w", width).withColumn("__cell", F.floor(F.col("cp_pos") / F.col("__w")))
    placed = (
        alarms.join(widths, "stream_id", "left")
        .withColumn("__w", F.explode_outer("__widths"))
        .withColumn("__home", F.floor(F.col("alarm_pos") / F.col("__w")))
        .withColumn("__cell", F.explode_outer(F.array(F.col("__home") - 1, F.col("__home"))))
        .drop("__widths", "__home")
    )
    matched = placed.join(near_points, ["stream_id", "__w", "__cell"], "left").withColumn(
        "__ok", (F.col("alarm_pos") >= F.col("cp_pos")) & (F.col("alarm_pos") <= F.col("cp_pos") + F.col("tol"))
    )
    taken = matched.groupBy("stream_id", "alarm_pos").agg(
        F.min_by(F.when(F.col("__ok"), F.col("cp_pos")), F.when(F.col("__ok"), F.col("cp_order"))).alias("cp_pos")
    )
    firsts = (
        taken.filter(F.col("cp_pos").isNotNull())
        .groupBy("stream_id", "cp_pos")
        .agg(F.count(F.lit(1)).alias("hits"), (F.min("alarm_pos") - F.col("cp_pos")).alias("delay"))
    )
    by_point = firsts.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("matched"), F.sum("hits").alias("true_alarms"), F.avg("delay").alias("mean_delay")
    )
    n_alarms = alarms.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_alarms"))
    n_points = change_points.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_points"))
    joined = streams.select("stream_id").distinct()
    for part in (by_point, n_alarms, n_points):
        joined = joined.join(part, "stream_id", "left")
    zero = F.lit(0).cast("long")
    joined = joined.select(
        "stream_id", "mean_delay",
        *[F.coalesce(c, zero).alias(c) for c in ("matched", "true_alarms", "n_alarms", "n_points")],
    )
    precision = F.when(F.col("n_alarms") > 0, F.col("true_alarms") / F.col("n_alarms")).otherwise(0.0)
    recall = F.when(F.col("n_points") > 0, F.col("matched") / F.col("n_points")).otherwise(0.0)
    scored = joined.withColumn("precision", precision).withColumn("recall", recall)
    both = F.col("precision") + F.col("recall")
    return scored.withColumn(
        "f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)
    ).select(
        "stream_id", "precision", "recall", "f1", "mean_delay", "n_alarms",
        (F.col("n_alarms") - F.col("true_alarms")).alias("false_alarms"),
    )
