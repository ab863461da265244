"""Fitting an isolation forest: every tree gets a full sample."""

import numpy as np
import pytest

from siftguard.operators import outliers


@pytest.mark.parametrize("n, trees, sample", [(300, 7, 64), (300, 3, 50), (20, 4, 64)])
def test_forest_has_all_trees_on_full_samples(spark, n, trees, sample):
    x = np.random.default_rng(1).normal(size=(n, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, a double, b double")
    forest, size = outliers.isolation_forest_fit(df, ["a", "b"], ["id"], trees, sample)
    assert len(forest) == trees and size == min(n, sample)
    # A sample of two or more different rows is split at least once.
    assert all(len(nodes) > 1 for nodes in forest)
    again, _ = outliers.isolation_forest_fit(df, ["a", "b"], ["id"], trees, sample)
    assert again == forest
