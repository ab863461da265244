"""Every query with a SQL twin gives the same rows as DuckDB; the others run."""

import pytest

import __spark_entry__ as entry
from siftguard.plans.registry import ORACLES, QUERIES
from tests.compare import compare, connect

# Long searches, run by hand with tests/run_oracles.py; their parts are tested on their own.
SLOW = {
    "lambda_sensitivity", "cross_validate_baselines", "label_budget_curve", "compare_insider_rankings",
    "compare_drift_detectors", "evaluate_policies", "evolve_rules", "incremental_policy",
}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_twins_are_registered():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, con, sf_dir, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], sf_dir) == ""
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, sf_dir, name):
    # Streams shorter than the warm-up give no rows.
    df = QUERIES[name](spark, sf_dir)
    assert all(len(r) == len(df.columns) for r in df.collect())
    spark.catalog.clearCache()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
