import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftguard.functions.ks import critical_gap
from siftguard.operators import drift


def make_streams(n=1500, seed=1):
    """Stream a shifts often, b once, c never; d is too short for any window."""
    rng = np.random.default_rng(seed)
    out = {}
    for name, size in (("a", n), ("b", n - 333), ("c", n // 2), ("d", 30)):
        x = rng.normal(size=(size, 2)).round(2)
        if name == "a":
            x[:, 0] += 3 * ((np.arange(size) // 260) % 3)
        if name == "b":
            x[size // 2:, 1] *= 8
        out[name] = x
    return out


@pytest.fixture(scope="module")
def streams(spark):
    data = make_streams()
    rows = [(k, i, r.tolist()) for k, x in data.items() for i, r in enumerate(x)]
    return data, spark.createDataFrame(rows, "stream_id string, pos long, features array<double>")


def gap(a, b):
    worst = 0
    for v in np.concatenate([a, b]):
        worst = max(worst, abs(int((a <= v).sum()) * len(b) - int((b <= v).sum()) * len(a)))
    return worst


def signal(ref, cur, alpha):
    m = ref.shape[1]
    limit = critical_gap(len(ref), len(cur), alpha / m)
    return any(gap(ref[:, f], cur[:, f]) >= limit for f in range(m))


def plain_confirmed(x, window, step, alpha, confirm):
    alarms, start, end, run = [], 0, 2 * window, 0
    while end <= len(x):
        run = run + 1 if signal(x[start: start + window], x[end - window: end], alpha) else 0
        if run == confirm:
            alarms.append(end)
            start, end, run = end, end + 2 * window, 0
        else:
            end += step
    return alarms


def plain_trailing(x, warm, window, alpha, confirm):
    step = max(50, window // 4)
    alarms, ref, run, last = [], x[:warm], 0, warm
    for i in range(warm, len(x)):
        if i - last >= step and i >= window:
            last = i
            run = run + 1 if signal(ref, x[i - window: i], alpha) else 0
            if run == confirm:
                alarms.append(i)
                ref, run = x[i - window: i], 0
    return alarms


def plain_exploring(x, warm, window, step, alpha, confirm, refits=(0, 300, 600), rest=400):
    alarms, points, run, quiet_until, planned = [], [], 0, 0, []
    ref = x[warm - window: warm]
    for i in range(warm, len(x)):
        if planned and i >= planned[0]:
            planned.pop(0)
            points.append(i)
            if not planned:
                ref = x[i - window: i]
        if (i - warm) % step == 0 and i - warm >= window and i >= quiet_until and not planned:
            run = run + 1 if signal(ref, x[i - window: i], alpha) else 0
            if run >= confirm:
                alarms.append(i)
                planned = [i + d for d in refits]
                run, quiet_until = 0, i + refits[-1] + rest
    return alarms, points


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.stream_id, []).append(r.alarm_pos)
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("block_windows,confirm", [(7, 1), (3, 3), (2000, 1), (2000, 3)])
def test_confirmed_detector(streams, block_windows, confirm):
    data, df = streams
    rule = drift.confirmed_rule(60, 15, confirm=confirm)
    want = {k: plain_confirmed(x, 60, 15, 0.05, confirm) for k, x in data.items()}
    got = found(drift.ks_confirm_detector(df, rule, block_windows))
    assert got == {k: v for k, v in want.items() if v}
    assert len(want["a"]) > 2


def test_step_that_does_not_divide_the_window(streams):
    data, df = streams
    want = {k: plain_confirmed(x, 50, 13, 0.05, 2) for k, x in data.items()}
    got = found(drift.ks_confirm_detector(df, drift.confirmed_rule(50, 13, confirm=2), 3))
    assert got == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("block_windows", [4, 2000])
def test_trailing_detector(streams, block_windows):
    data, df = streams
    want = {k: plain_trailing(x, 150, 60, 0.05, 2) for k, x in data.items()}
    got = found(drift.ks_confirm_detector(df, drift.trailing_rule(150, 60, confirm=2), block_windows))
    assert got == {k: v for k, v in want.items() if v}
    assert want["a"]


@pytest.mark.parametrize("block_windows", [9, 2000])
def test_exploring_detector_and_refits(spark, block_windows):
    from siftguard.operators.policy import refit_versions

    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 2)).round(2)
    x[:, 0] += 3 * ((np.arange(6000) // 1700) % 2)
    df = spark.createDataFrame([("s", i, r.tolist()) for i, r in enumerate(x)], "stream_id string, pos long, features array<double>")
    alarms, points = plain_exploring(x, 400, 100, 50, 0.02, 2)
    rule = drift.exploring_rule(400, 100, 50)
    got = drift.ks_confirm_detector(df, rule, block_windows)
    assert found(got) == {"s": alarms} and len(alarms) >= 2
    lengths = df.groupBy("stream_id").agg((F.max("pos") + 1).alias("__n"))
    fits = sorted(r.fit_pos for r in refit_versions(got, lengths, (1, 300, 600), 300).collect())
    assert fits == points


def test_order_of_rows_does_not_matter(streams):
    _, df = streams
    rule = drift.confirmed_rule(60, 15)
    assert found(drift.ks_confirm_detector(df.orderBy(F.rand(3)), rule, 20)) == found(
        drift.ks_confirm_detector(df, rule, 20)
    )


@pytest.mark.parametrize("block_windows", [1, 4, 2000])
def test_window_signals(streams, block_windows):
    data, df = streams
    rule = drift.confirmed_rule(60, 25)
    got = {(r.stream_id, r.window_id): (r.gap, r.signal) for r in drift.window_signals(df, rule, block_windows).collect()}
    limit, want = critical_gap(60, 60, 0.025), {}
    for k, x in data.items():
        for j, end in enumerate(range(120, len(x) + 1, 25)):
            g = max(gap(x[:60, f], x[end - 60: end, f]) for f in range(2))
            want[k, j] = (g, g >= limit)
    assert got == want and any(s for _, s in got.values())


def test_online_equals_batch(streams):
    from siftguard.streaming.jobs import OnlineKs

    data, _ = streams
    rule = drift.confirmed_rule(60, 15)
    limit = critical_gap(60, 60, 0.025)
    for x in data.values():
        for sizes in ([len(x)], [7] * 400, [200, 3, 500] * 5):
            state, alarms, at = None, [], 0
            for size in sizes:
                part = x[at: at + size]
                detector = OnlineKs(rule, 2, limit, state)
                # Two old rows come again; they are late and must be dropped.
                lo = max(0, at - 2)
                alarms += detector.feed(np.arange(lo, at + len(part)), x[lo: at + len(part)])
                state, at = detector.state(), at + len(part)
                assert len(state[5]) <= 2 * (2 * 60 + size + 15)
            assert alarms == plain_confirmed(x[:at], 60, 15, 0.05, 3)


def test_ks_statistic_on_two_samples(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 9, 200).astype(float), rng.integers(2, 12, 150).astype(float)
    pdf = pd.DataFrame({"k": 1, "v": np.concatenate([a, b]), "first": [True] * 200 + [False] * 150})
    row = drift.ks_statistic(spark.createDataFrame(pdf), ["k"], "v", F.col("first")).first()
    assert abs(row.distance - gap(a, b) / (200 * 150)) < 1e-12 and (row.n1, row.n2) == (200, 150)


def test_score_alarms(spark):
    points = [("s", i, p) for i, p in enumerate([14352, 19500, 33240, 38682, 39510])] + [("quiet", 0, 100)]
    alarms = [("s", p) for p in (100, 14400, 15000, 39600, 41000, 41511)] + [("none", 5)]
    names = spark.createDataFrame([("s",), ("quiet",), ("none",)], "stream_id string")
    got = {
        r.stream_id: r
        for r in drift.score_alarms(
            spark.createDataFrame(alarms, "stream_id string, alarm_pos long"),
            spark.createDataFrame(points, "stream_id string, cp_order int, cp_pos long"), 2000, names,
        ).collect()
    }
    # 39600 belongs to the earlier 38682, 41000 to 39510; 41511 is one too late.
    s = got["s"]
    assert (s.n_alarms, s.false_alarms) == (6, 2)
    assert abs(s.recall - 3 / 5) < 1e-12 and abs(s.precision - 4 / 6) < 1e-12
    assert abs(s.mean_delay - ((14400 - 14352) + (39600 - 38682) + (41000 - 39510)) / 3) < 1e-9
    assert got["quiet"].f1 == 0.0 and got["quiet"].mean_delay is None and got["quiet"].n_alarms == 0
    assert (got["none"].false_alarms, got["none"].recall) == (1, 0.0)


def test_tolerance_by_kind(spark):
    points = spark.createDataFrame([("s", 0, 100, "sudden"), ("s", 1, 900, "gradual")], "stream_id string, cp_order int, cp_pos long, cp_type string")
    alarms = spark.createDataFrame([("s", 805), ("s", 2500)], "stream_id string, alarm_pos long")
    tol = F.when(F.col("cp_type") == "sudden", 700).otherwise(1800)
    row = drift.score_alarms(alarms, points, tol, points).first()
    assert (row.false_alarms, row.recall) == (1, 0.5)
