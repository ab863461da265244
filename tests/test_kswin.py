"""KSWIN draws a sample only where it can matter; the alarms are those of drawing always."""

import numpy as np
import pytest

from siftguard.functions.ks import critical_gap, window_gaps
from siftguard.operators import detectors


def plain(values, size=100, recent=30, alpha=0.005):
    kept, drawn, alarms = [], 0, []
    for i, v in enumerate(values):
        kept = [*kept, float(v)][-size:]
        if len(kept) < size:
            continue
        drawn += 1
        old, new = np.array(kept[:-recent]), np.array(kept[-recent:])
        sample = np.sort(np.random.default_rng([0, drawn]).choice(old, recent, replace=False))
        gap = int(window_gaps(sample, new[None, :])[0])
        if gap >= critical_gap(recent, recent, alpha) and gap / recent**2 > 0.1:
            kept = kept[-recent:]
            alarms.append(i)
    return alarms


@pytest.mark.parametrize("rates", [(0.08, 0.45), (0.3, 0.9), (0.0, 1.0), None])
def test_kswin_against_drawing_always(rates):
    rng = np.random.default_rng(6)
    at = np.arange(3_000)
    x = rng.normal(size=3_000) + at // 700 % 2 if rates is None else (rng.random(3_000) < np.where(at // 400 % 2, *rates[::-1])).astype(int)
    alarms, _ = detectors.advance("kswin", detectors.fresh_state("kswin"), at, x)
    assert alarms == plain(x.tolist())


def test_kswin_draws_nothing_on_few_errors(monkeypatch):
    made = []
    real = np.random.default_rng
    x = (real(2).random(2_000) < 0.05).astype(int)
    monkeypatch.setattr(np.random, "default_rng", lambda *a: made.append(a) or real(*a))
    detectors.advance("kswin", detectors.fresh_state("kswin"), np.arange(2_000), x)
    assert len(made) < 200
