"""Registered queries on streams: drift detection, alarm scoring and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftguard.functions.ks import critical_gap, pvalue_column
from siftguard.operators import detectors, drift, policy
from siftguard.operators.running import stream_positions
from siftguard.plans.common import (
    FEATURES_PER_STREAM,
    STEP,
    WARM,
    WINDOW,
    change_points,
    event_stream,
    query,
    r6,
    stream_sql,
    table,
)
from siftguard.session import materialize
from siftguard.streaming import jobs

RULE = drift.confirmed_rule(WINDOW, STEP)
FIRST_END = 2 * WINDOW
LIMIT = critical_gap(WINDOW, WINDOW, RULE.alpha / FEATURES_PER_STREAM)
TOLERANCE = 400


@query(
    "standardize_prefix",
    stream_sql(
        "SELECT stream_id, pos, round((f0 - m0) / s0, 6) AS z0, round((f1 - m1) / s1, 6) AS z1, "
        "round((f2 - m2) / s2, 6) AS z2 FROM st JOIN mom USING (stream_id)",
        "mom AS (SELECT stream_id, "
        + ", ".join(
            f"avg(f{i}) AS m{i}, coalesce(nullif(stddev_pop(f{i}), 0), 1) AS s{i}" for i in range(FEATURES_PER_STREAM)
        )
        + f" FROM st WHERE pos < {WARM} GROUP BY stream_id)",
    ),
)
def standardize_prefix(spark, sf_dir):
    z = drift.standardize_prefix(event_stream(spark, sf_dir), WARM)
    return z.select("stream_id", "pos", *[F.round(F.col("features")[i], 6).alias(f"z{i}") for i in range(3)])


_WINDOWS_SQL = f"""win AS (
  SELECT stream_id, j AS window_id, {FIRST_END} + j * {STEP} AS e
  FROM lens, range(0, 1000000) t(j) WHERE {FIRST_END} + j * {STEP} <= n)"""


@query(
    "sliding_samples",
    stream_sql(
        f"SELECT st.stream_id, pos, window_id FROM st JOIN win ON st.stream_id = win.stream_id "
        f"AND pos >= e - {WINDOW} AND pos < e",
        _WINDOWS_SQL,
    ),
)
def sliding_samples(spark, sf_dir):
    samples = drift.sliding_samples(event_stream(spark, sf_dir), WINDOW, STEP, FIRST_END)
    return samples.select("stream_id", "pos", "window_id")


_TWO_SAMPLES_SQL = """half AS (SELECT stream_id, f, v, CASE WHEN (pos // 1000) % 2 = 0 THEN 1 ELSE 0 END AS a FROM lng),
cnt AS (SELECT stream_id, f, v, sum(a) AS a, sum(1 - a) AS b FROM half GROUP BY stream_id, f, v),
cum AS (SELECT stream_id, f, sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM cnt
  WINDOW w AS (PARTITION BY stream_id, f ORDER BY v)),
ks AS (SELECT stream_id, f, max(ca) AS n1, max(cb) AS n2,
    max(abs(ca / n1 - cb / n2)) AS distance
  FROM cum JOIN (SELECT stream_id, f, sum(a) AS n1, sum(b) AS n2 FROM cnt GROUP BY stream_id, f) USING (stream_id, f)
  WHERE n1 > 0 AND n2 > 0 GROUP BY stream_id, f),
pv AS (SELECT *, distance * sqrt(n1 * n2 / (n1 + n2)) AS x FROM ks),
pval AS (SELECT *, CASE WHEN x < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101),
    lambda j: (CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * j * j * x * x))))) END AS p FROM pv)"""


def two_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of the even to the odd thousands of rows, per stream and feature."""
    rows = event_stream(spark, sf_dir).select("stream_id", "pos", F.posexplode("features").alias("f", "v"))
    return drift.ks_statistic(rows, ["stream_id", "f"], "v", F.floor(F.col("pos") / 1000) % 2 == 0)


@query(
    "ks_statistic",
    stream_sql("SELECT stream_id, f, n1, n2, round(distance, 9) AS distance FROM ks", _TWO_SAMPLES_SQL),
)
def ks_statistic(spark, sf_dir):
    return two_samples(spark, sf_dir).withColumn("distance", F.round("distance", 9))


@query("ks_pvalue", stream_sql("SELECT stream_id, f, round(p, 6) AS p FROM pval", _TWO_SAMPLES_SQL))
def ks_pvalue(spark, sf_dir):
    p = pvalue_column(F.col("distance"), F.col("n1"), F.col("n2"))
    return two_samples(spark, sf_dir).select("stream_id", "f", F.round(p, 6).alias("p"))


@query(
    "bonferroni_signal",
    stream_sql(
        f"SELECT stream_id, count(*) AS m, min(p) < {RULE.alpha} / count(*) AS signal FROM pval GROUP BY stream_id",
        _TWO_SAMPLES_SQL,
    ),
)
def bonferroni_signal(spark, sf_dir):
    p = pvalue_column(F.col("distance"), F.col("n1"), F.col("n2"))
    return two_samples(spark, sf_dir).groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("m"), (F.min(p) < RULE.alpha / F.count(F.lit(1))).alias("signal")
    )


_FIXED_SQL = f"""{_WINDOWS_SQL},
smp AS (
  SELECT win.stream_id, window_id, f, v, 1 AS a, 0 AS b FROM win JOIN lng ON win.stream_id = lng.stream_id AND pos < {WINDOW}
  UNION ALL
  SELECT win.stream_id, window_id, f, v, 0, 1 FROM win JOIN lng ON win.stream_id = lng.stream_id
    AND pos >= e - {WINDOW} AND pos < e),
cum AS (SELECT stream_id, window_id, sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM smp
  WINDOW w AS (PARTITION BY stream_id, window_id, f ORDER BY v)),
sig AS (SELECT stream_id, window_id, CAST(max(abs(ca - cb)) * {WINDOW} AS BIGINT) AS gap,
  max(abs(ca - cb)) * {WINDOW} >= {LIMIT} AS signal FROM cum GROUP BY stream_id, window_id),
isl AS (SELECT *, coalesce(max(CASE WHEN NOT signal THEN window_id END) OVER
  (PARTITION BY stream_id ORDER BY window_id), -1) AS quiet FROM sig),
runs AS (SELECT stream_id, window_id, window_id - quiet AS run FROM isl)"""


@query(
    "fixed_reference_drift",
    stream_sql("SELECT stream_id, window_id, gap, signal FROM sig", _FIXED_SQL),
)
def fixed_reference_drift(spark, sf_dir):
    return drift.window_signals(event_stream(spark, sf_dir), RULE)


@query("consecutive_signals", stream_sql("SELECT stream_id, window_id, run FROM runs", _FIXED_SQL))
def consecutive_signals(spark, sf_dir):
    signals = drift.window_signals(event_stream(spark, sf_dir), RULE).persist()
    return drift.consecutive_signals(signals).select("stream_id", "window_id", "run")


@query(
    "ks_first_alarm",
    stream_sql(
        f"""SELECT stream_id, min(CASE WHEN run >= 1 THEN window_id END) * {STEP} + {FIRST_END} AS first_signal,
        min(CASE WHEN run >= {RULE.confirm} THEN window_id END) * {STEP} + {FIRST_END} AS first_alarm
        FROM runs GROUP BY stream_id""",
        _FIXED_SQL,
    ),
)
def ks_first_alarm(spark, sf_dir):
    """First signal and first confirmed alarm per stream, all windows against the first reference."""
    signals = drift.window_signals(event_stream(spark, sf_dir), RULE).persist()
    end = F.col("window_id") * STEP + FIRST_END
    return drift.consecutive_signals(signals).groupBy("stream_id").agg(
        F.min(F.when(F.col("run") >= 1, end)).alias("first_signal"),
        F.min(F.when(F.col("run") >= RULE.confirm, end)).alias("first_alarm"),
    )


# All pairs of a possible reference start and a later window end, then the chain of alarms.
_CHAIN_SQL = f"""ends AS (SELECT stream_id, n, 0 AS a FROM lens UNION ALL SELECT win.stream_id, n, e
    FROM win JOIN lens ON win.stream_id = lens.stream_id),
pair AS (SELECT stream_id, a, a + {FIRST_END} + i * {STEP} AS e FROM ends, range(0, 100000) t(i)
  WHERE a + {FIRST_END} + i * {STEP} <= n),
psm AS (
  SELECT pair.stream_id, a, e, f, v, 1 AS x, 0 AS y FROM pair JOIN lng ON pair.stream_id = lng.stream_id
    AND pos >= a AND pos < a + {WINDOW}
  UNION ALL
  SELECT pair.stream_id, a, e, f, v, 0, 1 FROM pair JOIN lng ON pair.stream_id = lng.stream_id
    AND pos >= e - {WINDOW} AND pos < e),
pcum AS (SELECT stream_id, a, e, sum(x) OVER w AS ca, sum(y) OVER w AS cb FROM psm
  WINDOW w AS (PARTITION BY stream_id, a, e, f ORDER BY v)),
psig AS (SELECT stream_id, a, e, max(abs(ca - cb)) * {WINDOW} >= {LIMIT} AS s FROM pcum GROUP BY stream_id, a, e),
conf AS (SELECT stream_id, a, e, s AND lag(s, 1) OVER w AND lag(s, 2) OVER w AS c FROM psig
  WINDOW w AS (PARTITION BY stream_id, a ORDER BY e)),
nxt AS (SELECT stream_id, a, min(e) AS b FROM conf WHERE c GROUP BY stream_id, a),
chain AS (SELECT stream_id, b FROM nxt WHERE a = 0 UNION ALL
  SELECT nxt.stream_id, nxt.b FROM chain JOIN nxt ON nxt.stream_id = chain.stream_id AND nxt.a = chain.b)"""


@query(
    "ks_confirm_detector",
    stream_sql("SELECT stream_id, CAST(b AS BIGINT) AS alarm_pos FROM chain", _WINDOWS_SQL, _CHAIN_SQL),
)
def ks_confirm_detector(spark, sf_dir):
    return drift.ks_confirm_detector(event_stream(spark, sf_dir), RULE)


# Line numbers repeat within an order; these columns settle the order of the rows.
_LINE_ORDER = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")


def lineitem_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items in order key, line number order, as one stream."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.lit("lineitem").alias("stream_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"),
        *_LINE_ORDER,
        F.array("l_quantity", "l_extendedprice", "l_discount").alias("features"),
    )
    placed = stream_positions(rows, "stream_id", "row_id", ties=_LINE_ORDER)
    return placed.select("stream_id", "pos", "features")


@query("ks_detector_single_stream")
def ks_detector_single_stream(spark, sf_dir):
    """All line items as one stream, with and without confirmation."""
    stream = materialize(lineitem_stream(spark, sf_dir), "lineitem-stream")
    out = None
    for confirm in (1, 3):
        alarms = drift.ks_confirm_detector(stream, drift.confirmed_rule(confirm=confirm))
        part = alarms.withColumn("confirm", F.lit(confirm))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "stream_ks_drift",
    stream_sql("SELECT stream_id, CAST(b AS BIGINT) AS alarm_pos FROM chain", _WINDOWS_SQL, _CHAIN_SQL),
)
def stream_ks_drift(spark, sf_dir):
    """The same alarms from a streaming job that runs four times."""
    stream = event_stream(spark, sf_dir).select("stream_id", "pos", "features")
    split = F.least(F.floor(F.col("pos") / 550), F.lit(3)).cast("int")

    def build(source):
        return jobs.stream_ks_drift(source, RULE, FEATURES_PER_STREAM)

    return jobs.replay(spark, stream, split, 4, build, "drift")


# --- error streams -----------------------------------------------------------------------

_TRACE_SQL = """tr AS (SELECT stream_id, pos, CASE WHEN
  (CASE WHEN (f0 > 30) <> (CAST(f2 AS BIGINT) % 10 = 0) THEN 1 ELSE 0 END) = y THEN 1 ELSE 0 END AS correct FROM st)"""


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correctness of a fixed threshold that drift and a tenth of noise lead astray."""
    f = F.col("features")
    predicted = ((f[0] > 30) != (f[2].cast("long") % 10 == 0)).cast("int")
    return event_stream(spark, sf_dir).select(
        "stream_id", "pos", (predicted == F.col("y")).cast("int").alias("correct")
    )


@query("error_stream_detectors")
def error_stream_detectors(spark, sf_dir):
    return detectors.error_stream_detectors(trace(spark, sf_dir))


@query(
    "ddm_first_alarm",
    stream_sql(
        "SELECT stream_id, min(pos) AS alarm_pos FROM low WHERE r + d > lr + 3.0 * ld GROUP BY stream_id",
        _TRACE_SQL,
        """cn AS (SELECT stream_id, pos, count(*) OVER w AS n, sum(1 - correct) OVER w AS er FROM tr
          WINDOW w AS (PARTITION BY stream_id ORDER BY pos)),
        rt AS (SELECT stream_id, pos, n, er / n AS r, sqrt((er / n) * (1.0 - er / n) / n) AS d FROM cn),
        low AS (SELECT stream_id, pos, r, d, arg_min(r, r + d) OVER w AS lr, arg_min(d, r + d) OVER w AS ld
          FROM rt WHERE n >= 30 WINDOW w AS (PARTITION BY stream_id ORDER BY pos))""",
    ),
)
def ddm_first_alarm(spark, sf_dir):
    return detectors.ddm_first_alarm(trace(spark, sf_dir))


_ALARMS_SQL = "al AS (SELECT stream_id, pos AS alarm_pos FROM st WHERE pos > 0 AND pos % 170 = 0)"
_SCORE_SQL = f"""hit AS (SELECT al.stream_id, alarm_pos, arg_min(cp_pos, cp_order) AS cp_pos
  FROM al LEFT JOIN cps ON cps.stream_id = al.stream_id AND alarm_pos BETWEEN cp_pos AND cp_pos + {TOLERANCE}
  GROUP BY al.stream_id, alarm_pos),
pt AS (SELECT stream_id, cp_pos, count(*) AS hits, min(alarm_pos) - cp_pos AS delay FROM hit
  WHERE cp_pos IS NOT NULL GROUP BY stream_id, cp_pos),
tot AS (SELECT lens.stream_id,
  (SELECT count(*) FROM al WHERE al.stream_id = lens.stream_id) AS n_alarms,
  (SELECT count(*) FROM cps WHERE cps.stream_id = lens.stream_id) AS n_points,
  (SELECT count(*) FROM pt WHERE pt.stream_id = lens.stream_id) AS matched,
  (SELECT coalesce(sum(hits), 0) FROM pt WHERE pt.stream_id = lens.stream_id) AS true_alarms,
  (SELECT avg(delay) FROM pt WHERE pt.stream_id = lens.stream_id) AS mean_delay FROM lens),
pr AS (SELECT *, coalesce(true_alarms / nullif(n_alarms, 0), 0.0) AS precision,
  coalesce(matched / nullif(n_points, 0), 0.0) AS recall FROM tot)"""


@query(
    "score_alarms",
    stream_sql(
        """SELECT stream_id, round(precision, 6) AS precision, round(recall, 6) AS recall,
        round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0), 6) AS f1,
        round(mean_delay, 6) AS mean_delay, n_alarms, n_alarms - true_alarms AS false_alarms FROM pr""",
        _ALARMS_SQL, _SCORE_SQL,
    ),
)
def score_alarms(spark, sf_dir):
    stream = event_stream(spark, sf_dir)
    alarms = stream.filter((F.col("pos") > 0) & (F.col("pos") % 170 == 0)).select(
        "stream_id", F.col("pos").alias("alarm_pos")
    )
    scored = drift.score_alarms(alarms, change_points(stream), TOLERANCE, stream)
    return scored.select(
        "stream_id", *r6("precision", "recall", "f1", "mean_delay"), "n_alarms", "false_alarms"
    )


@query("compare_drift_detectors")
def compare_drift_detectors(spark, sf_dir):
    """Alarm scores of the KS detector with and without confirmation and of the error detectors."""
    stream = materialize(event_stream(spark, sf_dir), "compare-stream")
    points = change_points(stream)
    found = {
        "ks_confirmed": drift.ks_confirm_detector(stream, RULE),
        "ks_unconfirmed": drift.ks_confirm_detector(stream, drift.confirmed_rule(WINDOW, STEP, confirm=1)),
    }
    errors = detectors.error_stream_detectors(trace(spark, sf_dir))
    for kind in detectors.KINDS:
        found[kind] = errors.filter(F.col("kind") == kind).select("stream_id", "alarm_pos")
    out = None
    for method, alarms in found.items():
        part = drift.score_alarms(alarms, points, TOLERANCE, stream).withColumn("method", F.lit(method))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("method").agg(
        *[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1", "mean_delay", "false_alarms")]
    )


# --- policies --------------------------------------------------------------------------------


@query(
    "prequential_accuracy",
    stream_sql(
        """SELECT stream_id, pos, round(avg(correct) OVER (PARTITION BY stream_id ORDER BY pos
        ROWS BETWEEN 499 PRECEDING AND CURRENT ROW), 6) AS accuracy FROM tr""",
        _TRACE_SQL,
    ),
)
def prequential_accuracy(spark, sf_dir):
    return policy.prequential_accuracy(trace(spark, sf_dir)).select("stream_id", "pos", *r6("accuracy"))


@query(
    "policy_for_segment",
    stream_sql(
        f"""SELECT st.stream_id, pos, max(vs.fit_pos) AS fit_pos FROM st JOIN vs
        ON st.stream_id = vs.stream_id AND vs.active_from <= pos GROUP BY st.stream_id, pos""",
        f"""vs AS (SELECT stream_id, CAST(0 AS BIGINT) AS fit_pos, {WARM} AS active_from FROM lens
          UNION ALL SELECT stream_id, cp_pos, cp_pos + 1 FROM cps)""",
    ),
)
def policy_for_segment(spark, sf_dir):
    """The version active at each row, if a new one were fitted at every change point."""
    stream = event_stream(spark, sf_dir)
    alarms = change_points(stream).select("stream_id", F.col("cp_pos").alias("alarm_pos"))
    lengths = stream.groupBy("stream_id").agg((F.max("pos") + 1).alias("__n"))
    later = policy.refit_versions(alarms, lengths, (0,), 300)
    versions = policy.first_versions(stream, WARM).unionByName(later)
    return policy.policy_for_segment(stream.select("stream_id", "pos"), versions)


def _policy_summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("fit_pos").alias("n_versions"),
        F.round(F.avg("correct"), 6).alias("accuracy"),
    )


@query("static_policy")
def static_policy(spark, sf_dir):
    return _policy_summary(policy.static_policy(event_stream(spark, sf_dir), WARM))


@query("adaptive_rule_policy")
def adaptive_rule_policy(spark, sf_dir):
    return _policy_summary(policy.adaptive_rule_policy(event_stream(spark, sf_dir), WARM))


@query("adaptive_tree_policy")
def adaptive_tree_policy(spark, sf_dir):
    stream = event_stream(spark, sf_dir)
    return _policy_summary(policy.adaptive_tree_policy(stream, WARM, window=200, refit_rows=600))


@query("incremental_policy")
def incremental_policy(spark, sf_dir):
    stream = drift.standardize_prefix(event_stream(spark, sf_dir), WARM)
    scored = policy.incremental_policy(stream, WARM)
    return scored.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("correct"), 6).alias("accuracy")
    )


_STRATEGIES_SQL = """tra AS (
  SELECT stream_id, 'static' AS strategy, CAST(0 AS BIGINT) AS fit_pos, CASE WHEN (f0 > 30) = (y = 1) THEN 1 ELSE 0 END AS correct FROM st
  UNION ALL
  SELECT stream_id, 'adaptive', CAST(pos // 1000 * 1000 AS BIGINT),
    CASE WHEN (f0 > CASE WHEN (pos // 1000) % 2 = 1 AND pos % 1000 >= 200 THEN 90 ELSE 30 END) = (y = 1) THEN 1 ELSE 0 END FROM st
  UNION ALL
  SELECT stream_id, 'incremental', NULL, CASE WHEN (f0 > 50) = (y = 1) THEN 1 ELSE 0 END FROM st),
me AS (SELECT stream_id, strategy, avg(correct) AS accuracy, count(DISTINCT CASE WHEN fit_pos > 0 THEN fit_pos END) AS retrains
  FROM tra GROUP BY stream_id, strategy)"""


@query(
    "compare_policies",
    stream_sql(
        """SELECT me.stream_id, me.strategy, round(me.accuracy, 6) AS accuracy, me.retrains,
        round(100.0 * (me.accuracy - b.accuracy) / b.accuracy, 6) AS gain_pct
        FROM me JOIN me b ON b.stream_id = me.stream_id AND b.strategy = 'static'""",
        _STRATEGIES_SQL,
    ),
)
def compare_policies(spark, sf_dir):
    """Three threshold strategies: never moved, moved 200 rows after each change, in between."""
    stream = event_stream(spark, sf_dir)
    value, truth = F.col("features")[0], F.col("y") == 1
    shifted = (F.floor(F.col("pos") / 1000) % 2 == 1) & (F.col("pos") % 1000 >= 200)
    fitted = F.floor(F.col("pos") / 1000).cast("long") * 1000

    def row(name, fit_pos, limit):
        return F.struct(
            F.lit(name).alias("strategy"), fit_pos.cast("long").alias("fit_pos"),
            ((value > limit) == truth).cast("int").alias("correct"),
        )

    strategies = F.array(
        row("static", F.lit(0), F.lit(30)),
        row("adaptive", fitted, F.when(shifted, 90).otherwise(30)),
        row("incremental", F.lit(None), F.lit(50)),
    )
    traces = stream.select("stream_id", F.explode(strategies).alias("s")).select("stream_id", "s.*")
    return policy.compare_policies(traces).select("stream_id", "strategy", *r6("accuracy"), "retrains", *r6("gain_pct"))


@query("evaluate_policies")
def evaluate_policies(spark, sf_dir):
    """Fitted policies side by side on the event streams."""
    stream = materialize(event_stream(spark, sf_dir), "policy-stream")
    scaled = drift.standardize_prefix(stream, WARM)
    runs = {
        "static": policy.static_policy(scaled, WARM, "tree"),
        "adaptive": policy.adaptive_tree_policy(scaled, WARM, window=200, refit_rows=600),
        "incremental": policy.incremental_policy(scaled, WARM).withColumn("fit_pos", F.lit(None).cast("long")),
    }
    traces = None
    for name, run in runs.items():
        part = run.select("stream_id", F.lit(name).alias("strategy"), "fit_pos", "correct")
        traces = part if traces is None else traces.unionByName(part)
    return policy.compare_policies(traces).select("stream_id", "strategy", *r6("accuracy"), "retrains", *r6("gain_pct"))
