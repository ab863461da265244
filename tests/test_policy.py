import numpy as np
import pytest
from pyspark.sql import functions as F

from siftguard.operators import detectors, policy
from siftguard.operators.models import fit_rules, fit_tree, predict_rules, predict_tree


@pytest.fixture(scope="module")
def stream(spark):
    rng = np.random.default_rng(4)
    rows, data = [], {}
    for name, n in (("a", 2600), ("b", 900)):
        x = rng.normal(size=(n, 2)).round(3)
        flip = (np.arange(n) // 1200) % 2
        x[:, 1] += 4 * flip
        y = ((x[:, 0] > 0) ^ (flip == 1)).astype(int)
        data[name] = (x, y)
        rows += [(name, i, x[i].tolist(), int(y[i])) for i in range(n)]
    return data, spark.createDataFrame(rows, "stream_id string, pos long, features array<double>, y int").persist()


def test_models_fit_their_window():
    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    y = ((x[:, 0] > 0.6) & (x[:, 2] < 0.5)).astype(int)
    nodes = np.array(fit_tree(x, y))
    assert (predict_tree(nodes, x) == y).mean() > 0.99
    rules = np.array(fit_rules(x, y)).reshape(-1, 4)
    assert (predict_rules(rules, x) == y).mean() > 0.85
    assert len(set(rules[:, 0])) <= 6 and fit_rules(x, np.zeros(400, int)) == []
    multi = (x[:, 1] * 3).astype(int)
    assert (predict_tree(np.array(fit_tree(x, multi)), x) == multi).all()
    assert (predict_tree(np.array(fit_tree(x[:1], y[:1])), x) == y[0]).all()


@pytest.mark.parametrize("block", [130, 50_000])
def test_assignment_to_versions(stream, block):
    data, df = stream
    alarms = df.sparkSession.createDataFrame([("a", 700), ("a", 1300), ("b", 899)], "stream_id string, alarm_pos long")
    lengths = df.groupBy("stream_id").agg((F.max("pos") + 1).alias("__n"))
    later = policy.refit_versions(alarms, lengths, (1, 300), 250)
    assert sorted((r.stream_id, r.fit_pos, r.train_from) for r in later.collect()) == [
        ("a", 701, 451), ("a", 1000, 750), ("a", 1301, 1051), ("a", 1600, 1350)
    ]
    versions = policy.first_versions(df, 300).unionByName(later)
    got = {(r.stream_id, r.pos): r.fit_pos for r in policy.policy_for_segment(df, versions, block).collect()}
    fits = {"a": [701, 1000, 1301, 1600], "b": []}
    want = {
        (s, p): max([0] + [f for f in fits[s] if f < p]) for s in data for p in range(300, len(data[s][1]))
    }
    assert got == want
    listed = {(r.stream_id, r.block, r.fit_pos) for r in policy.versions_by_block(df, versions, block).collect()}
    assert {(s, p // block, f) for (s, p), f in want.items()} <= listed


@pytest.mark.parametrize("block", [170, 50_000])
def test_scores_against_plain_loop(stream, block):
    data, df = stream
    versions = policy.first_versions(df, 300)
    models = policy.fit_versions(df, versions, "tree", block)
    got = policy.score_versions(df, versions, models, "tree", block).collect()
    assert len(got) == sum(len(y) - 300 for _, y in data.values())
    for s, (x, y) in data.items():
        right = predict_tree(np.array(fit_tree(x[:300], y[:300])), x[300:]) == y[300:]
        mine = sorted((r.pos, r.correct) for r in got if r.stream_id == s)
        assert [c for _, c in mine] == right.astype(int).tolist()


def test_adaptive_beats_static_after_a_change(stream):
    _, df = stream
    static = policy.static_policy(df, 300, "tree").select("stream_id", F.lit("static").alias("strategy"), "fit_pos", "correct")
    moved = policy.adaptive_tree_policy(df, 300, window=200, refit_rows=400)
    both = static.unionByName(moved.select("stream_id", F.lit("adaptive").alias("strategy"), "fit_pos", "correct"))
    got = {(r.stream_id, r.strategy): r for r in policy.compare_policies(both).collect()}
    assert got["a", "adaptive"].accuracy > got["a", "static"].accuracy + 0.2
    assert got["a", "adaptive"].retrains >= 1 and got["a", "static"].gain_pct == 0.0
    assert got["b", "adaptive"].retrains == 0
    rules = policy.adaptive_rule_policy(df, 300)
    assert rules.count() == 2300 + 600


def test_a_version_that_scores_nothing_counts(spark):
    traces = spark.createDataFrame([("a", "static", 0, 1), ("a", "adaptive", 0, 1)], "stream_id string, strategy string, fit_pos long, correct int")
    versions = spark.createDataFrame([("a", "adaptive", 0), ("a", "adaptive", 99)], "stream_id string, strategy string, fit_pos long")
    got = {r.strategy: r.retrains for r in policy.compare_policies(traces, versions=versions).collect()}
    assert got == {"static": 0, "adaptive": 1}
    assert {r.retrains for r in policy.compare_policies(traces).collect()} == {0}


def test_incremental_learns(stream):
    data, df = stream
    scored = policy.incremental_policy(df.filter("stream_id = 'b'"), 300, block_rows=150).collect()
    assert sorted(r.pos for r in scored) == list(range(300, 900))
    assert np.mean([r.correct for r in scored]) > 0.9
    # Another, longer stream changes nothing.
    both = policy.incremental_policy(df, 300, block_rows=150).filter("stream_id = 'b'").collect()
    assert sorted(map(tuple, both)) == sorted(map(tuple, scored))


# --- detectors on error streams -----------------------------------------------------


@pytest.fixture(scope="module")
def trace(spark):
    rng = np.random.default_rng(9)
    rows = []
    for name, n in (("a", 3000), ("b", 1700)):
        rate = np.where((np.arange(n) // 800) % 2 == 1, 0.45, 0.08)
        rows += [(name, i, int(rng.random() > rate[i])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "stream_id string, pos long, correct int")


def test_blocks_do_not_change_the_alarms(trace):
    rows, df = trace
    whole = sorted(map(tuple, detectors.error_stream_detectors(df).collect()))
    cut = sorted(map(tuple, detectors.error_stream_detectors(df, block=777).collect()))
    assert whole == cut
    for name in ("a", "b"):
        part = [(p, 1 - c) for s, p, c in rows if s == name and p >= 200]
        pos, err = np.array(part).T
        for kind in detectors.KINDS:
            alarms, _ = detectors.advance(kind, detectors.fresh_state(kind), pos, err)
            assert [(name, kind, p) for p in alarms] == [a for a in whole if a[:2] == (name, kind)]
    assert {k for _, k, _ in whole} == set(detectors.KINDS)


@pytest.mark.parametrize("block", [97, 100_000])
def test_ddm_by_running_sums(trace, block):
    rows, df = trace
    got = {r.stream_id: r.alarm_pos for r in detectors.ddm_first_alarm(df, block=block).collect()}
    for name in ("a", "b"):
        detector = detectors.Ddm()
        first = next(p for s, p, c in rows if s == name and detector.update(1 - c))
        assert got[name] == first


def test_adwin_keeps_exact_totals():
    rng = np.random.default_rng(1)
    detector, kept = detectors.Adwin(), []
    for v in (rng.random(1500) < 0.3).astype(int):
        detector.update(int(v))
        kept.append(int(v))
        n, s, d = detector._totals()
        assert n <= len(kept) and abs(s - sum(kept[len(kept) - int(n):])) < 1e-9
        assert len(detector.buckets) < 80
    window = np.array(kept[-int(n):])
    assert abs(d - ((window - window.mean()) ** 2).sum()) < 1e-6


def test_adwin_sees_a_jump_and_rests_otherwise():
    rng = np.random.default_rng(2)
    quiet = detectors.Adwin()
    assert sum(quiet.update(int(v)) for v in rng.random(4000) < 0.2) <= 1
    jump = detectors.Adwin()
    values = (rng.random(2000) < np.where(np.arange(2000) < 1000, 0.1, 0.6)).astype(int)
    hits = [i for i, v in enumerate(values) if jump.update(int(v))]
    assert hits and 1000 < hits[0] < 1200
