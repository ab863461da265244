"""Rounds of the KS detector do not follow the number of blocks."""

from glob import glob

import numpy as np
import pytest

from siftguard.operators import drift
from siftguard.session import scratch_root
from tests.test_drift import found, plain_confirmed


@pytest.mark.parametrize("kind", ["changes", "quiet", "one"])
def test_few_rounds_whatever_the_blocks(spark, kind):
    rng = np.random.default_rng(8)
    n, rule = 3_000, drift.confirmed_rule(20, 5, confirm=2)
    level = {"changes": np.arange(n) // 150 % 2, "quiet": np.zeros(n), "one": np.arange(n) > 700}[kind]
    x = np.stack([rng.random(n) + 3 * level, rng.random(n)], axis=1)
    if kind == "quiet":
        x = np.stack([np.arange(n) % 5.0, np.arange(n) % 4.0], axis=1)
    df = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)], "stream_id string, pos long, features array<double>")
    name = f"few-{kind}"
    got = found(drift.ks_confirm_detector(df, rule, 10, name))
    assert got.get("s", []) == plain_confirmed(x, 20, 5, 0.05, 2)
    # 60 blocks of 50 rows.
    assert len(glob(f"{scratch_root(spark)}/{name}-rounds-*/round=*")) <= 16
