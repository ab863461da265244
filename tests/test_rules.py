import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftguard.operators import metrics, rules
from siftguard.operators.rule_search import Proposer, SearchSettings, evolve_rules, sequential_covering, specialize_rule

RULES = [[("a", 1, 0.5)], [("b", -1, 0.2), ("c", 1, 0.1)], [("c", 1, 0.9)]]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.random((400, 3)), columns=list("abc"))
    pdf["label"] = ((pdf.a > 0.7) | ((pdf.b < 0.2) & (pdf.c > 0.5))).astype(int)
    pdf["id"] = range(400)
    return pdf, spark.createDataFrame(pdf).persist()


def plain(pdf, ruleset):
    out = np.zeros(len(pdf), dtype=bool)
    for rule in ruleset:
        held = np.ones(len(pdf), dtype=bool)
        for f, op, t in rule:
            held &= (pdf[f] > t) if op > 0 else (pdf[f] < t)
        out |= held
    return np.asarray(out).astype(int)


def test_decisions_and_texts(rows):
    pdf, df = rows
    got = rules.apply_rule_set(df, RULES).orderBy("id").toPandas()
    assert (got.predicted.to_numpy() == plain(pdf, RULES)).all()
    why = rules.explain_decisions(df, RULES, "id").orderBy("id").toPandas()
    for fired, texts in zip(got.fired_rules, why.why):
        assert list(texts) == [rules.describe(RULES[i]) for i in fired]
    assert rules.describe([("x", 1, 0.12345), ("y", -1, 2.0)]) == "IF x > 0.123 AND y < 2 THEN confidential"


def test_comparisons_are_strict(spark):
    df = spark.createDataFrame([(1, 0.5, 0.2, 0.9)], "id int, a double, b double, c double")
    assert rules.apply_rule_set(df, RULES).first().predicted == 0
    assert rules.apply_rule_set(df, []).first().predicted == 0


def test_scores_by_batch_and_expression_agree(rows):
    pdf, df = rows
    sets = [RULES, RULES[:1], [], RULES[1:]] + [[[("a", 1, i / 40)]] for i in range(40)]
    many = {r.set_id: r for r in rules.score_rule_sets(df, "label", sets).collect()}
    few = {r.set_id: r for r in rules.score_rule_sets(df, "label", sets[:6]).collect()}
    for i, s in enumerate(sets):
        p, y = plain(pdf, s), pdf.label.to_numpy()
        tp, fp, fn = ((p & y).sum(), (p & (1 - y)).sum(), ((1 - p) & y).sum())
        assert (many[i].tp, many[i].fp, many[i].fn) == (tp, fp, fn)
        f1 = 2 * tp / (2 * tp + fp + fn)
        assert abs(many[i].fitness - (f1 - 0.05 * rules.complexity(s, 8, 3))) < 1e-12
        if i in few:
            assert few[i] == many[i]


def test_stored_rules_and_patch(spark, rows):
    pdf, df = rows
    table = rules.rule_table(spark, {0: RULES, 7: RULES[:1]})
    assert rules.rules_from_table(table) == {0: RULES, 7: RULES[:1]}
    patched = rules.rules_from_table(rules.patch_rule_set(table, 7, [("c", 1, 0.0)]))
    assert patched == {0: RULES, 7: [RULES[0], [("c", 1, 0.0)]]}

    def recall(s):
        return metrics.binary_metrics(rules.apply_rule_set(df, s), "label", "predicted").first().recall

    assert recall(patched[7]) >= recall(RULES[:1])


def test_metrics_on_nothing(spark):
    none = spark.createDataFrame([], "label int, predicted int")
    row = metrics.with_scores(metrics.confusion(none, "label", "predicted")).first()
    assert (row.precision, row.recall, row.f1, row.fnr, row.fpr) == (0.0, 0.0, 0.0, 1.0, 0.0)


def test_interpretability_without_positives(rows):
    _, df = rows
    row = rules.rule_interpretability(df, [[("a", 1, 9.0)]]).first()
    assert row.share_pos_explained_le2_rules == 1.0


def test_threshold_candidates(rows):
    pdf, df = rows
    got = rules.threshold_candidates(df, "label", ["a", "b"], rules.fires(RULES[0])).toPandas()
    open_pos = pdf[(pdf.label == 1) & ~(pdf.a > 0.5)]
    for f in "ab":
        part = got[got.feature == f].set_index("kind")
        m1, m0 = open_pos[f].mean(), pdf[pdf.label == 0][f].mean()
        op = 1 if m1 > m0 else -1
        assert part.loc["midpoint", "op"] == op
        assert abs(part.loc["midpoint", "thr"] - (m1 + m0) / 2) < 1e-9
        for kind, q in (("p10", 10), ("p25", 25), ("p50", 50)):
            assert abs(part.loc[kind, "thr"] - (np.percentile(open_pos[f], q) - 1e-9 * op)) < 1e-12


def test_search_finds_the_hidden_rules(rows):
    _, df = rows

    def f1(s):
        return metrics.binary_metrics(rules.apply_rule_set(df, s), "label", "predicted").first().f1

    covering = sequential_covering(df, "label", list("abc"))
    assert f1(covering) > 0.85 and len(covering) <= 8
    short = SearchSettings(population=30, generations=3, restarts=1, patience=2)
    best = evolve_rules(df, "label", list("abc"), short)
    cost = 0.05 * rules.complexity(covering, 8, 3)
    assert best.fitness >= f1(covering) - cost - 1e-9
    assert best.history == sorted(best.history)


def test_specialize_adds_to_the_worst_rule(rows):
    _, df = rows
    s = SearchSettings()
    stats = rules.class_statistics(df, "label", list("abc")).collect()
    proposer = Proposer(stats, list("abc"), s, np.random.default_rng(0))
    start = [[("a", 1, 0.7)], [("b", -1, 0.6)]]
    got = specialize_rule(df, "label", start, proposer, s)
    assert got[0] == start[0] and got[1][0] == start[1][0] and len(got[1]) == 2
    full = [[("b", -1, 0.9), ("a", 1, -1.0), ("c", 1, -1.0)]]
    assert specialize_rule(df, "label", full, proposer, s) == full


@pytest.mark.parametrize("n", [16, 17])
def test_missing_values_and_labels(spark, n):
    rows = [(1.0, 1), (float("nan"), 1), (None, 1), (0.0, 0), (2.0, 0), (2.0, None)]
    df = spark.createDataFrame(rows, "a double, label int")
    sets = [[[("a", 1, 0.5)]]] * n
    for r in rules.score_rule_sets(df, "label", sets).collect():
        assert (r.tp, r.fp, r.fn) == (1, 1, 2)
    assert rules.apply_rule_set(df, sets[0]).filter("predicted = 1").count() == 3


def test_proposals_stay_well_formed():
    stats = [
        type("Row", (), dict(feature=f, mean_pos=i, mean_neg=1.0, std=0.5, median=0.7, lowest=0.0, highest=2.0)) for i, f in enumerate("abcde")
    ]
    s = SearchSettings()
    propose = Proposer(stats, list("abcde"), s, np.random.default_rng(1))
    sets = propose.random_sets(40)
    sets.put(slice(0, 20), propose.midpoint_sets(20))
    for _ in range(60):
        pairs = np.random.default_rng(2).permutation(40)
        sets = propose.change(propose.cross(sets, sets.take(pairs)))
        for rules_ in propose.decode(sets):
            assert 1 <= len(rules_) <= s.max_rules and all(1 <= len(r) <= s.max_conds for r in rules_)
        again = propose.encode(propose.decode(sets))
        assert (again.feature == sets.feature).all()


def test_covering_falls_back_to_a_midpoint(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 0), (1.0, 0)], "a double, label int")
    assert sequential_covering(df, "label", ["a"]) == []
    df = spark.createDataFrame([(1.0, 1), (1.0, 0)], "a double, label int")
    assert len(sequential_covering(df, "label", ["a"])) == 1


def test_ranking_metrics(spark):
    scores = [("a", 5.0, 1), ("b", 5.0, 0), ("c", 4.0, 1), ("d", 1.0, 0), ("e", 0.5, 0), ("f", 0.5, 1)]
    df = spark.createDataFrame(scores, "user string, s double, y int")
    got = {r.metric: r.value for r in metrics.ranking_metrics(df, "s", "y", "user", (1, 2, 4)).collect()}
    pairs = [(1.0 if p > n else 0.5 if p == n else 0.0) for _, p, y in scores if y for _, n, z in scores if not z]
    assert abs(got["auc"] - np.mean(pairs)) < 1e-12
    assert abs(got["ap"] - (1 / 3) * (1 / 2 + 2 / 3 + 3 / 6)) < 1e-12
    assert (got["precision@1"], got["precision@2"], got["recall@4"]) == (1.0, 0.5, 2 / 3)


def test_fold_mean_std_skips_missing(spark):
    df = spark.createDataFrame([("m", 1.0), ("m", 3.0), ("m", float("nan")), ("m", None)], "k string, value double")
    row = metrics.fold_mean_std(df, ["k"]).first()
    assert (row["mean"], row["std"], row["n"]) == (2.0, 1.0, 2)
