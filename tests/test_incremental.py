"""Incremental policy: against a plain loop, with rounds that do not follow the blocks."""

import numpy as np
import pytest

from siftguard.operators import policy

WARM = 40


def plain(rows, classes, block_rows):
    """pos -> (predicted, correct) of one stream; rows are (pos, features, y)."""
    width = max(len(f) for _, f, _ in rows) + 1
    w = np.zeros((classes, width))
    blocks = {}
    for pos, f, y in rows:
        blocks.setdefault(max((pos - WARM) // block_rows, -1), []).append((pos, f, y))
    out = {}
    for b in sorted(blocks):
        used = [([1.0, *f], y) for _, f, y in blocks[b] if None not in f]
        if b >= 0:
            for pos, f, y in blocks[b]:
                p = None if None in f else int(np.argmax(w @ np.array([1.0, *f])))
                out[pos] = (p, None if p is None or y is None else int(p == y))
        x = np.array([f for f, _ in used])
        hot = np.array([[float(y == c) for c in range(classes)] for _, y in used])
        for _ in range(8 if b < 0 else 1):
            w = w + (hot - 1 / (1 + np.exp(-x @ w.T))).T @ x / len(x)
    return out


@pytest.mark.parametrize("round_values", [100, 2_000_000])
def test_incremental_against_a_plain_loop(spark, round_values):
    rng = np.random.default_rng(3)
    streams = {}
    for name, n in (("a", 700), ("b", 333), ("c", 30)):
        x = rng.normal(size=(n, 2)) + np.where(np.arange(n) % 200 < 100, 0, 1)[:, None]
        y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 1)
        streams[name] = [
            (i, [None if i % 97 == 5 else float(v) for v in x[i]], None if i % 89 == 7 else int(y[i])) for i in range(n)
        ]
    data = [(s, *r) for s, rows in streams.items() for r in rows]
    df = spark.createDataFrame(data, "stream_id string, pos long, features array<double>, y int").repartition(5)
    spark.sparkContext.setJobGroup(f"incremental-{round_values}", "")
    scored = policy.incremental_policy(df, WARM, block_rows=5, round_values=round_values)
    got = {(r.stream_id, r.pos): (r.predicted, r.correct) for r in scored.collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"incremental-{round_values}")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = {(s, p): v for s, rows in streams.items() for p, v in plain(rows, 3, 5).items()}
    assert got == want
    if round_values > 100:
        # 132 blocks in one round.
        assert len(jobs) < 40
