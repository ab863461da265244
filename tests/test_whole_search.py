"""The registered search over weights runs to its end, with the library's own settings."""

from siftguard.operators import classifiers, rule_search
from siftguard.plans.registry import QUERIES


def test_lambda_sensitivity_runs_the_whole_search(spark, sf_dir, monkeypatch):
    seen = []
    evolve = rule_search.evolve_many

    def search(index, survey, settings):
        seen.extend(settings)
        return evolve(index, survey, settings)

    monkeypatch.setattr(classifiers, "evolve_many", search)
    rows = QUERIES["lambda_sensitivity"](spark, sf_dir).collect()
    spark.catalog.clearCache()
    assert sorted(r["lam"] for r in rows) == [0.0, 0.02, 0.05, 0.1, 0.2]
    assert all(0 <= r["f1_mean"] <= 1 and 1 <= r["rules_mean"] <= 8 for r in rows)
    whole = rule_search.SearchSettings()
    assert len(seen) == 15
    for name in ("population", "generations", "restarts", "patience", "max_rules", "max_conds"):
        assert {getattr(s, name) for s in seen} == {getattr(whole, name)}
