"""Bitmap index and long-form statistics against plain loops."""

import numpy as np
import pytest

from siftguard.operators import rules
from siftguard.operators.bitmaps import Ask, build_index, count_rule_sets, encode
from siftguard.operators.rule_search import SearchSettings, evolve_many, evolve_rules, survey_columns

NAMES = [f"c{i}" for i in range(30)]


@pytest.fixture(scope="module")
def wide(spark):
    """Mostly empty columns with negative values, NULL and NaN, and rows without a label."""
    rng = np.random.default_rng(7)
    x = np.where(rng.random((700, 30)) < 0.3, rng.integers(-3, 6, (700, 30)) / 4, 0.0)
    x[:, 3] = rng.normal(size=700)
    x[:, 4] = 0.0
    x[rng.random(x.shape) < 0.02] = np.nan
    label = [None if i % 50 == 0 else int(v) for i, v in enumerate(rng.random(700) < 0.3)]
    rows = [(*[None if i % 7 == 0 and v != v else float(v) for v in r], y) for i, (r, y) in enumerate(zip(x, label))]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in NAMES) + ", label int").repartition(3).cache()
    return x, np.array([-1 if y is None else y for y in label]), df


def meets(x, rule):
    with np.errstate(invalid="ignore"):
        parts = [x[:, NAMES.index(f)] > t if op > 0 else x[:, NAMES.index(f)] < t for f, op, t in rule]
    return np.logical_and.reduce(parts)


def some_rules(rng, n):
    return [
        [(NAMES[rng.integers(30)], int(rng.choice([-1, 1])), float(rng.choice([-0.5, 0.0, 0.25, rng.normal()]))) for _ in range(rng.integers(1, 4))]
        for _ in range(n)
    ]


@pytest.mark.parametrize("block_rows", [64, 16_384])
def test_counts(wide, block_rows):
    x, y, df = wide
    rng = np.random.default_rng(1)
    sets = [[], *[some_rules(rng, rng.integers(1, 6)) for _ in range(300)]]
    within, beyond = some_rules(rng, 1)[0][:1], some_rules(rng, 2)
    index = build_index(df, "label", NAMES, block_rows)
    whole, part = count_rule_sets(index, [Ask(*encode(index, sets)), Ask(*encode(index, sets), within=within, beyond=beyond)])
    covered = np.logical_or.reduce([meets(x, r) for r in beyond])
    for counters, pos, neg in (
        (whole, y == 1, y == 0), (part, (y == 1) & meets(x, within) & ~covered, (y == 0) & meets(x, within)),
    ):
        for (tp, fp, positives), rules_ in zip(counters.T, sets):
            hit = np.logical_or.reduce([meets(x, r) for r in rules_]) if rules_ else np.zeros(len(x), bool)
            assert (tp, fp, positives) == ((hit & pos).sum(), (hit & neg).sum(), pos.sum())


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "a double, label int")
    index = build_index(df, "label", ["a"])
    [counters] = count_rule_sets(index, [Ask(*encode(index, [[[("a", 1, 0.0)]]]))])
    assert counters.tolist() == [[0], [0], [0]]
    assert rules.index_thresholds(index) == [("a", -1, k, None, 0) for k in ("midpoint", "p10", "p25", "p50")]
    stats = rules.class_statistics(df, "label", ["a"]).first()
    assert stats.feature == "a" and stats.mean_pos is None and stats["median"] is None


def test_statistics_of_columns(wide):
    x, y, df = wide
    # NaN is a value to averages; statistics are compared on columns without it.
    clean = df.na.fill(0.0, NAMES)
    x = np.nan_to_num(x)
    for f, r in enumerate(rules.class_statistics(clean, "label", NAMES).collect()):
        v = x[:, f]
        want = (v[y == 1].mean(), v[y == 0].mean(), v.std(), np.sort(v)[-(-len(v) // 2) - 1], v.min(), v.max())
        assert r.feature == NAMES[f] and np.allclose(tuple(r)[1:], want, atol=1e-12)


def test_thresholds(wide):
    x, y, df = wide
    covered = [[("c3", 1, 0.5)], [("c1", 1, 0.0), ("c2", -1, 0.5)]]
    hit = np.logical_or.reduce([meets(x, r) for r in covered])
    by_index = rules.index_thresholds(build_index(df, "label", NAMES, 100), covered)
    by_column = [tuple(r) for r in rules.threshold_candidates(df, "label", NAMES, rules.decides(covered)).collect()]
    assert len(by_index) == len(by_column) == 4 * len(NAMES)
    found = {r[:3]: r[3:] for r in by_column}
    for f, op, kind, thr, n in by_index:
        assert found[(f, op, kind)][1] == n == ((y == 1) & ~hit).sum()
        assert abs(found[(f, op, kind)][0] - thr) < 1e-12
        v, w = x[(y == 1) & ~hit, NAMES.index(f)], x[y == 0, NAMES.index(f)]
        v, w = v[v == v], w[w == w]
        want = (v.mean() + w.mean()) / 2 if kind == "midpoint" else np.percentile(v, int(kind[1:])) - 1e-9 * op
        assert op == (1 if v.mean() > w.mean() else -1) and abs(thr - want) < 1e-9


def test_searches_in_step_find_what_they_find_alone(wide):
    df = wide[2].na.fill(0.0, NAMES)
    s = SearchSettings(population=20, generations=4, restarts=2, patience=3)
    other = SearchSettings(population=20, generations=6, restarts=1, patience=2, lam=0.2, seed=5)
    index = build_index(df, "label", NAMES)
    both = evolve_many(index, survey_columns(df, "label", NAMES, s, index), [s, other])
    for settings, found in zip((s, other), both):
        alone = evolve_rules(df, "label", NAMES, settings)
        assert (alone.rules, alone.history) == (found.rules, found.history)
        scored = rules.score_rule_sets(df, "label", [found.rules], settings.lam).first()
        assert abs(scored["fitness"] - found.fitness) < 1e-12
