from itertools import combinations
from math import comb

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftguard.functions.ks import EXACT_LIMIT, critical_gap, exact_pvalue_column, pvalue, pvalue_column, tail_probability, window_gaps


def exact_tail(n1, n2, gap):
    """Share of all orderings of two samples with at least this gap."""
    hit = 0
    for first in combinations(range(n1 + n2), n1):
        chosen, c1, worst = set(first), 0, 0
        for i in range(n1 + n2):
            c1 += i in chosen
            worst = max(worst, abs(c1 * n2 - (i + 1 - c1) * n1))
        hit += worst >= gap
    return hit / comb(n1 + n2, n1)


@pytest.mark.parametrize("n1,n2", [(3, 3), (4, 4), (5, 5), (3, 5), (4, 6), (2, 7)])
@pytest.mark.parametrize("alpha", [0.3, 0.1, 0.02])
def test_critical_gap_against_enumeration(n1, n2, alpha):
    gap = critical_gap(n1, n2, alpha)
    smallest = next((g for g in range(1, n1 * n2 + 1) if exact_tail(n1, n2, g) < alpha), None)
    if smallest is None:
        assert gap > n1 * n2
    else:
        assert exact_tail(n1, n2, gap) < alpha
        # Gaps come in steps; no reachable gap below it rejects.
        reachable = [g for g in range(1, gap) if exact_tail(n1, n2, g) < alpha]
        assert not reachable or exact_tail(n1, n2, reachable[0]) == exact_tail(n1, n2, gap)


def test_known_critical_counts():
    assert critical_gap(300, 300, 0.05 / 10) == 43 * 300
    assert critical_gap(250, 250, 0.02 / 10) == 42 * 250
    assert critical_gap(666, 666, 0.05 / 33) == 70 * 666


def test_asymptotic_close_to_exact():
    exact, rough = critical_gap(9_999, 9_999, 0.01) / 9_999**2, critical_gap(10_001, 10_001, 0.01) / 10_001**2
    assert abs(exact - rough) < 2e-4


samples = st.lists(st.integers(0, 6), min_size=4, max_size=4)


@settings(max_examples=60, deadline=None)
@given(samples, samples)
def test_window_gap_is_the_largest_distance(a, b):
    ref, win = np.sort(np.array(a, float)), np.array([b], float)
    want = max(abs(sum(x <= v for x in a) * 4 - sum(x <= v for x in b) * 4) for v in range(7))
    assert window_gaps(ref, win)[0] == want
    assert window_gaps(np.sort(win[0]), np.array([a], float))[0] == want


def test_pvalue(spark):
    row = spark.range(1).select(
        pvalue_column(F.lit(1.36), F.lit(2), F.lit(2)).alias("p"), pvalue_column(F.lit(0.0), F.lit(9), F.lit(9)).alias("q")
    ).first()
    assert abs(row.p - 0.0495) < 1e-4 and row.q == 1.0
    assert abs(tail_probability(1.36) - row.p) < 1e-12


@pytest.mark.parametrize("n1,n2", [(4, 4), (5, 5), (3, 5), (2, 7)])
def test_exact_pvalues_against_enumeration(n1, n2):
    for gap in range(0, n1 * n2 + 1):
        assert pvalue(n1, n2, gap, "exact") == pytest.approx(exact_tail(n1, n2, gap))


def test_method_changes_at_the_limit_only_with_auto():
    n = EXACT_LIMIT
    assert critical_gap(n, n, 0.01) == critical_gap(n, n, 0.01, "exact")
    assert critical_gap(n + 1, n + 1, 0.01) == critical_gap(n + 1, n + 1, 0.01, "asymptotic")
    assert pvalue(8, 8, 40, "asymptotic") != pvalue(8, 8, 40, "exact")
    with pytest.raises(ValueError):
        critical_gap(5, 5, 0.01, "other")


def test_exact_column(spark):
    df = spark.createDataFrame([(0.5, 4, 4), (0.6, 5, 5), (1.0, 2, 7), (0.0, 3, 3)], "d double, n1 long, n2 long")
    got = [r[0] for r in df.select(exact_pvalue_column(F.col("d"), F.col("n1"), F.col("n2"))).collect()]
    assert got == pytest.approx([exact_tail(4, 4, 8), exact_tail(5, 5, 15), exact_tail(2, 7, 14), 1.0])
