"""Registered queries on audit logs: user days, profiles, ranking and outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftguard.operators import metrics, outliers, profiles, sampling, user_days
from siftguard.operators.user_days import FEATURES
from siftguard.plans.common import event_rows, query, r6, table
from siftguard.session import keep_hot, scratch_path
from siftguard.sources import readers
from siftguard.streaming import jobs

WARMUP, SPLIT = 10, 18
RHO = 0.95
CONFIG = profiles.DetectorConfig(
    mask=(1.0, 0.0, 1.0, 1.0, 1.0, 0.0, 1.0, 1.0, 1.0, 0.0, 1.0),
    weights=(0.5, 1.0, 0.25, 0.3, 0.8, 1.0, 0.9, 1.2, 0.4, 1.0, 0.7),
    tau=1.5,
    rho=RHO,
)
FIRST_DAY, LAST_DAY = "2024-01-20", "2024-01-22"

# --- SQL building blocks ------------------------------------------------------------

BASE_SQL = """
base AS (
  SELECT CAST(user_id AS VARCHAR) AS "user", ts, CAST(ts AS DATE) AS date, event_type AS e, value,
         CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k,
         CASE WHEN hour(ts) < 7 OR hour(ts) >= 19 THEN 1 ELSE 0 END AS late,
         CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS weekend
  FROM events)""".strip()

DAYS_SQL = f"""{BASE_SQL},
ud AS (
  SELECT "user", date,
    CAST(sum(CASE WHEN e = 'signup' THEN 1 ELSE 0 END) AS DOUBLE) AS logons,
    CAST(sum(CASE WHEN e = 'signup' THEN late ELSE 0 END) AS DOUBLE) AS logon_afterhours,
    CAST(sum(CASE WHEN e = 'signup' THEN weekend ELSE 0 END) AS DOUBLE) AS logon_weekend,
    CAST(count(DISTINCT CASE WHEN e IN ('signup', 'view') THEN k % 5 END) AS DOUBLE) AS n_pc,
    CAST(sum(CASE WHEN e = 'click' THEN 1 ELSE 0 END) AS DOUBLE) AS usb_connects,
    CAST(sum(CASE WHEN e = 'click' THEN late ELSE 0 END) AS DOUBLE) AS usb_afterhours,
    CAST(sum(CASE WHEN e = 'error' THEN 1 ELSE 0 END) AS DOUBLE) AS file_copies,
    CAST(sum(CASE WHEN e = 'error' AND k % 4 = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS file_exe_zip,
    CAST(sum(CASE WHEN e = 'purchase' THEN 1 ELSE 0 END) AS DOUBLE) AS emails,
    CAST(sum(CASE WHEN e = 'purchase' AND k % 3 = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS email_external,
    sum(CASE WHEN e = 'purchase' THEN value ELSE 0.0 END) AS email_bytes
  FROM base GROUP BY "user", date),
bad AS (
  SELECT DISTINCT "user", CAST(d AS DATE) AS date
  FROM (SELECT DISTINCT "user" FROM base WHERE CAST("user" AS BIGINT) % 15 = 0),
       range(DATE '{FIRST_DAY}', DATE '{LAST_DAY}' + INTERVAL 1 DAY, INTERVAL 1 DAY) t(d)),
lab AS (
  SELECT ud.*, CASE WHEN bad.date IS NULL THEN 0 ELSE 1 END AS label
  FROM ud LEFT JOIN bad ON ud."user" = bad."user" AND ud.date = bad.date)"""

_ZEROS = ", ".join(f"coalesce({f}, 0.0) AS {f}" for f in FEATURES)
GRID_SQL = f"""{DAYS_SQL},
days AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS day FROM (SELECT DISTINCT date FROM ud)),
users AS (SELECT DISTINCT "user" FROM ud),
grid AS (
  SELECT c."user", c.date, c.day, {_ZEROS}, coalesce(label, 0) AS label
  FROM (SELECT * FROM users, days) c LEFT JOIN lab ON lab."user" = c."user" AND lab.date = c.date)"""

_LONG = "\nUNION ALL ".join(
    f"""SELECT "user", day, label, {i} AS f, {f} AS x FROM grid""" for i, f in enumerate(FEATURES)
)
_LEARN = repr(1 - RHO)
_MOVED = f"({RHO} * p.mu + {_LEARN} * g.x)"
SCORES_SQL = f"""{GRID_SQL},
lng AS ({_LONG}),
start AS (SELECT "user", f, avg(x) AS mu, var_pop(x) + 1e-6 AS va FROM lng WHERE day < {WARMUP} GROUP BY "user", f),
prof AS (
  SELECT "user", f, {WARMUP - 1} AS day, CAST(0 AS DOUBLE) AS z, mu, va FROM start
  UNION ALL
  SELECT p."user", p.f, g.day, greatest(CAST(0 AS DOUBLE), (g.x - p.mu) / sqrt(p.va)), {_MOVED},
         {RHO} * p.va + {_LEARN} * (g.x - {_MOVED}) * (g.x - {_MOVED}) + 1e-9
  FROM prof p JOIN lng g ON g."user" = p."user" AND g.f = p.f AND g.day = p.day + 1),
z AS (
  SELECT g."user", g.day, any_value(g.label) AS label, """ + ", ".join(
    f"max(CASE WHEN g.f = {i} THEN coalesce(p.z, 0.0) END) AS z_{f}" for i, f in enumerate(FEATURES)
) + f"""
  FROM lng g LEFT JOIN prof p ON p."user" = g."user" AND p.f = g.f AND p.day = g.day AND g.day >= {WARMUP}
  GROUP BY g."user", g.day)"""


def alarm_sql(config: profiles.DetectorConfig, name: str = "sc", source: str = "z") -> str:
    total = " + ".join(f"z_{f} * {float(w)!r}" for f, w in zip(FEATURES, config.loads))
    return (
        f"{name} AS (SELECT *, CASE WHEN score > {config.tau!r} THEN 1 ELSE 0 END AS alarm FROM "
        f"(SELECT *, ({total}) / {float(config.loads.sum()) + 1e-9!r} AS score FROM {source}))"
    )


def _with(body: str, *parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


# --- inputs ---------------------------------------------------------------------------


def audit_logs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The events in the shape of the four logs."""
    e = event_rows(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("id"), "ts", F.col("user_id").cast("string").alias("user"),
        F.concat(F.lit("pc"), (F.col("k") % 5).cast("string")).alias("pc"), "event_type", "value", "k",
    )
    kind = F.col("event_type")
    outside = F.col("k") % 3 == 0
    return {
        "logon": e.filter(kind.isin("signup", "view")).select(
            "id", "ts", "user", "pc", F.when(kind == "signup", "Logon").otherwise("Logoff").alias("activity")
        ),
        "device": e.filter(kind == "click").select("id", "ts", "user", "pc", F.lit("Connect").alias("activity")),
        "file": e.filter(kind == "error").select(
            "id", "ts", "user", "pc",
            F.concat(F.lit("copy"), F.col("k").cast("string"), F.when(F.col("k") % 4 == 0, ".ZIP").otherwise(".doc")).alias(
                "filename"
            ),
        ),
        "email": e.filter(kind == "purchase").select(
            "id", "ts", "user", "pc", F.lit("a@dtaa.com").alias("to"),
            F.when(outside, "x@other.org;b@dtaa.com").otherwise("").alias("cc"), F.lit("").alias("bcc"),
            F.lit("me@dtaa.com").alias("from"), F.col("value").cast("string").alias("size"),
        ),
    }


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").filter(F.col("user_id") % 15 == 0).select("user_id").distinct()
    return users.select(
        F.col("user_id").cast("string").alias("user"),
        F.lit(f"{FIRST_DAY} 09:00:00").cast("timestamp_ntz").alias("start"),
        F.lit(f"{LAST_DAY} 17:30:00").cast("timestamp_ntz").alias("end"),
    )


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = audit_logs(spark, sf_dir)
    return user_days.user_day_features(logs["logon"], logs["device"], logs["file"], logs["email"])


def labelled_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = sampling.malicious_user_days(intervals(spark, sf_dir))
    return user_days.label_user_days(days(spark, sf_dir), bad)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Used twice by the grid (calendar and cells): the user-days are kept, not the logs.
    return user_days.user_day_grid(labelled_days(spark, sf_dir).persist())


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.user_series(grid(spark, sf_dir))


def scored_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.weighted_alarm(profiles.profile_scores(series(spark, sf_dir), RHO, WARMUP), CONFIG)


# --- logs and user days ------------------------------------------------------------------


_LOG_COUNTS = f"""SELECT log, "user", count(*) AS n, max(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS last_seen FROM (
  SELECT CASE e WHEN 'click' THEN 'device' WHEN 'error' THEN 'file' WHEN 'purchase' THEN 'email' ELSE 'logon' END AS log,
         "user", ts FROM base) GROUP BY log, "user\""""


@query("read_audit_logs", _with(_LOG_COUNTS, BASE_SQL))
def read_audit_logs(spark, sf_dir):
    """Write the events as four CSV logs, read them back, count rows per user."""
    folder = scratch_path(spark, "audit")
    for name, log in audit_logs(spark, sf_dir).items():
        columns = [
            F.date_format("ts", readers.TIME_FORMAT).alias("date") if c == "date"
            else F.col(c) if c in log.columns else F.lit('said "so", twice').alias(c)
            for c in readers.LOG_COLUMNS[name]
        ]
        log.select(*columns).write.option("header", True).option("escape", '"').csv(f"{folder}/{name}.csv")
    logs = readers.read_audit_logs(spark, [f"{folder}/absent", folder])
    counted = None
    for name, log in logs.items():
        part = readers.accepted_rows(log).select(F.lit(name).alias("log"), "user", "ts")
        counted = part if counted is None else counted.unionByName(part)
    return counted.groupBy("log", "user").agg(
        F.count(F.lit(1)).alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_seen")
    )


@query(
    "read_insider_intervals",
    _with(
        f"""SELECT DISTINCT "user", '{FIRST_DAY}' AS first_day, '{LAST_DAY}' AS last_day FROM base
        WHERE CAST("user" AS BIGINT) % 15 = 0""",
        BASE_SQL,
    ),
)
def read_insider_intervals(spark, sf_dir):
    path = scratch_path(spark, "answers")
    rows = intervals(spark, sf_dir)
    both = rows.withColumn("dataset", F.explode(F.array(F.lit("4.2"), F.lit("5.1"))))
    both.select(
        "dataset", "user",
        *[F.date_format(c, readers.TIME_FORMAT).alias(c) for c in ("start", "end")],
    ).write.option("header", True).csv(path)
    found = readers.read_insider_intervals(spark, path)
    return found.select(
        "user", F.to_date("start").cast("string").alias("first_day"), F.to_date("end").cast("string").alias("last_day")
    )


@query("malicious_user_days", _with('SELECT "user", CAST(date AS VARCHAR) AS date FROM bad', DAYS_SQL))
def malicious_user_days(spark, sf_dir):
    found = sampling.malicious_user_days(intervals(spark, sf_dir))
    return found.select("user", F.col("date").cast("string").alias("date"))


_DAY_COLUMNS = ", ".join(FEATURES[:-1]) + ", round(email_bytes, 4) AS email_bytes"


def _shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        "user", F.col("date").cast("string").alias("date"), *more, *FEATURES[:-1],
        F.round("email_bytes", 4).alias("email_bytes"),
    )


@query("user_day_features", _with(f'SELECT "user", CAST(date AS VARCHAR) AS date, {_DAY_COLUMNS} FROM ud', DAYS_SQL))
def user_day_features(spark, sf_dir):
    return _shown(days(spark, sf_dir))


@query(
    "label_user_days",
    _with('SELECT "user", CAST(date AS VARCHAR) AS date, label FROM lab', DAYS_SQL),
)
def label_user_days(spark, sf_dir):
    return labelled_days(spark, sf_dir).select("user", F.col("date").cast("string").alias("date"), "label")


@query(
    "user_day_summary",
    _with('SELECT count(*) AS user_days, sum(label) AS malicious, count(DISTINCT "user") AS users FROM lab', DAYS_SQL),
)
def user_day_summary(spark, sf_dir):
    return user_days.user_day_summary(labelled_days(spark, sf_dir))


@query(
    "user_day_grid",
    _with(f'SELECT "user", CAST(date AS VARCHAR) AS date, day, label, {_DAY_COLUMNS} FROM grid', GRID_SQL),
)
def user_day_grid(spark, sf_dir):
    return _shown(grid(spark, sf_dir), "day", "label")


@query(
    "prefix_split",
    _with(
        f"""SELECT CASE WHEN day < {SPLIT} THEN 'train' ELSE 'test' END AS part, count(*) AS n, count(DISTINCT day) AS days,
        sum(label) AS malicious FROM lab JOIN days ON lab.date = days.date GROUP BY part""",
        GRID_SQL,
    ),
)
def prefix_split(spark, sf_dir):
    """Train and test user-days by the rank of the date."""
    rows = labelled_days(spark, sf_dir).persist()
    ranked = rows.join(profiles.rank_of_date(rows), "date")
    return sampling.prefix_split(ranked, "day", SPLIT).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("day").alias("days"), F.sum("label").alias("malicious")
    )


# --- profiles -------------------------------------------------------------------------------


@query(
    "profile_init",
    _with(
        "SELECT \"user\", CASE f "
        + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FEATURES))
        + " END AS feature, round(mu, 6) AS mu, round(va, 4) AS var FROM start",
        SCORES_SQL,
    ),
)
def profile_init(spark, sf_dir):
    found = profiles.profile_init(grid(spark, sf_dir), WARMUP)
    return found.select("user", "feature", *r6("mu"), F.round("var", 4).alias("var"))


@query(
    "profile_scores",
    _with(
        'SELECT "user", day, label, ' + ", ".join(f"round(z_{f}, 4) AS z_{f}" for f in FEATURES) + " FROM z",
        SCORES_SQL,
    ),
)
def profile_scores(spark, sf_dir):
    z = profiles.profile_scores(series(spark, sf_dir), RHO, WARMUP)
    return z.select("user", "day", "label", *[F.round(f"z_{f}", 4).alias(f"z_{f}") for f in FEATURES])


@query(
    "weighted_alarm",
    _with('SELECT "user", day, label, round(score, 4) AS score, alarm FROM sc', SCORES_SQL, alarm_sql(CONFIG)),
)
def weighted_alarm(spark, sf_dir):
    return scored_days(spark, sf_dir).select("user", "day", "label", F.round("score", 4).alias("score"), "alarm")


def candidate_configs(n: int = 24) -> list[profiles.DetectorConfig]:
    """A fixed family of configurations that share one forgetting rate."""
    width = len(FEATURES)
    return [
        profiles.DetectorConfig(
            tuple(float((i + j) % 3 != 0) for j in range(width)),
            tuple(0.1 + 0.1 * ((i * 7 + j * 3) % 10) for j in range(width)),
            1.0 + 0.125 * i,
            RHO,
        )
        for i in range(n)
    ]


def _fitness_sql() -> str:
    parts = []
    for i, c in enumerate(candidate_configs()):
        total = " + ".join(f"z_{f} * {float(w)!r}" for f, w in zip(FEATURES, c.loads))
        parts.append(
            f"SELECT {i} AS config_id, label, CASE WHEN ({total}) / {float(c.loads.sum()) + 1e-9!r} > {c.tau!r} "
            f"THEN 1 ELSE 0 END AS a FROM z WHERE day >= {WARMUP} AND day < {SPLIT}"
        )
    return (
        "al AS (" + "\nUNION ALL ".join(parts) + """),
cnt AS (SELECT config_id, sum(a * label) AS tp, sum(a * (1 - label)) AS fp, sum((1 - a) * label) AS fn,
  sum((1 - a) * (1 - label)) AS tn FROM al GROUP BY config_id),
f1s AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM cnt)"""
    )


@query(
    "detector_fitness",
    _with(
        "SELECT config_id, tp, fp, fn, tn, round(f1, 6) AS f1, "
        "round(f1 - 0.15 * fp / greatest(fp + tn, 1), 6) AS fitness FROM f1s",
        SCORES_SQL, _fitness_sql(),
    ),
)
def detector_fitness(spark, sf_dir):
    found = profiles.detector_fitness(series(spark, sf_dir), candidate_configs(), WARMUP, until_day=SPLIT)
    return found.select("config_id", "tp", "fp", "fn", "tn", *r6("f1", "fitness"))


@query("tune_detector")
def tune_detector(spark, sf_dir):
    """The best configuration on the days before the split, and its metrics after it."""
    rows = keep_hot(series(spark, sf_dir), 5_000)
    best, history = profiles.tune_detector(rows, until_day=SPLIT)
    scored = profiles.weighted_alarm(profiles.profile_scores(rows, best.rho, WARMUP), best)
    quality = metrics.binary_metrics(scored.filter(F.col("day") >= SPLIT), "label", "alarm")
    active = ",".join(f for f, m in zip(FEATURES, best.mask) if m > 0.5)
    return quality.select(
        F.lit(active).alias("active"), F.lit(best.tau).alias("tau"), F.lit(best.rho).alias("rho"),
        F.lit(len(history) - 1).alias("generations"), F.lit(history[-1]).alias("train_fitness"),
        "precision", "recall", "f1",
    )


@query(
    "evaluate_split",
    _with(
        """SELECT round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1,
        round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision,
        round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall,
        round(1.0 - coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS fnr,
        round(fp / greatest(fp + tn, 1), 6) AS fpr FROM (
          SELECT sum(alarm * label) AS tp, sum(alarm * (1 - label)) AS fp, sum((1 - alarm) * label) AS fn,
                 sum((1 - alarm) * (1 - label)) AS tn FROM sc WHERE day >= %d)""" % SPLIT,
        SCORES_SQL, alarm_sql(CONFIG),
    ),
)
def evaluate_split(spark, sf_dir):
    test = scored_days(spark, sf_dir).filter(F.col("day") >= SPLIT)
    scored = metrics.with_scores(metrics.confusion(test, "label", "alarm"))
    return scored.select(*r6("f1", "precision", "recall", "fnr", "fpr"))


_RISK_SQL = f"""risk AS (SELECT "user", max(score) AS risk FROM sc WHERE day >= {SPLIT} GROUP BY "user"),
ul AS (SELECT "user", max(label) AS label FROM z GROUP BY "user"),
rk AS (SELECT * FROM risk JOIN ul USING ("user"))"""


@query(
    "user_risk",
    _with('SELECT "user", round(risk, 4) AS risk FROM risk', SCORES_SQL, alarm_sql(CONFIG), _RISK_SQL),
)
def user_risk(spark, sf_dir):
    found = profiles.user_risk(scored_days(spark, sf_dir), SPLIT)
    return found.select("user", F.round("risk", 4).alias("risk"))


@query(
    "user_label",
    _with(
        f"""SELECT "user", max(label) AS label, max(CASE WHEN day >= {SPLIT} THEN label ELSE 0 END) AS test_label
        FROM grid GROUP BY "user\"""",
        GRID_SQL,
    ),
)
def user_label(spark, sf_dir):
    rows = grid(spark, sf_dir).persist()
    test = profiles.user_label(rows, SPLIT).withColumnRenamed("label", "test_label")
    return profiles.user_label(rows).join(test, "user")


def ranking_sql(source: str, score: str = "risk") -> str:
    """Ranking metrics over one row per user; order score descending, then user."""
    budgets = "\nUNION ALL ".join(
        f"""SELECT 'precision@{k}', (SELECT sum(label) FROM rn WHERE rn <= {k}) / {k}.0
        UNION ALL SELECT 'recall@{k}', (SELECT sum(label) FROM rn WHERE rn <= {k}) / nullif(np, 0.0) FROM tot"""
        for k in (20, 50, 100)
    )
    return f"""rn AS (SELECT *, row_number() OVER (ORDER BY {score} DESC, "user") AS rn,
    (rank() OVER (ORDER BY {score})) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0 AS avg_rank FROM {source}),
tot AS (SELECT CAST(sum(label) AS DOUBLE) AS np, CAST(sum(1 - label) AS DOUBLE) AS nn FROM rn),
grp AS (SELECT {score} AS s, sum(label) AS p, count(*) AS c FROM rn GROUP BY {score}),
cum AS (SELECT p, sum(p) OVER (ORDER BY s DESC) AS cp, sum(c) OVER (ORDER BY s DESC) AS cc FROM grp),
met(metric, value) AS (
  SELECT 'auc', ((SELECT sum(avg_rank) FROM rn WHERE label = 1) - np * (np + 1) / 2) / nullif(np * nn, 0) FROM tot
  UNION ALL SELECT 'ap', (SELECT sum(p * cp / cc) FROM cum) / nullif(np, 0) FROM tot
  UNION ALL SELECT 'positives', np FROM tot
  UNION ALL {budgets})"""


@query(
    "ranking_metrics",
    _with(
        "SELECT metric, round(value, 6) AS value FROM met",
        SCORES_SQL, alarm_sql(CONFIG), _RISK_SQL, ranking_sql("rk"),
    ),
)
def ranking_metrics(spark, sf_dir):
    scored = scored_days(spark, sf_dir).persist()
    users = profiles.user_risk(scored, SPLIT).join(profiles.user_label(scored), "user").persist()
    return metrics.ranking_metrics(users, "risk", "label", "user").select("metric", *r6("value"))


# --- population outliers -----------------------------------------------------------------------

_SCALED = ", ".join(
    f"(g.{f} - (SELECT avg({f}) FROM grid WHERE day < {SPLIT})) / "
    f"coalesce(nullif((SELECT stddev_pop({f}) FROM grid WHERE day < {SPLIT}), 0), 1) AS {f}"
    for f in FEATURES
)


@query(
    "standard_scale",
    _with(
        'SELECT "user", day, ' + ", ".join(f"round({f}, 6) AS {f}" for f in FEATURES) + " FROM scaled",
        GRID_SQL, f'scaled AS (SELECT g."user", g.day, {_SCALED} FROM grid g)',
    ),
)
def standard_scale(spark, sf_dir):
    rows = grid(spark, sf_dir).persist()
    scaled = outliers.standard_scale(rows, FEATURES, rows.filter(F.col("day") < SPLIT))
    return scaled.select("user", "day", *r6(*FEATURES))


def scaled_grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = grid(spark, sf_dir).persist()
    scaled = outliers.standard_scale(rows, FEATURES, rows.filter(F.col("day") < SPLIT)).persist()
    return scaled, scaled.filter(F.col("day") < SPLIT)


_KEEP = ["user", "day", "label"]


@query("isolation_forest")
def isolation_forest(spark, sf_dir):
    scaled, train = scaled_grid(spark, sf_dir)
    return outliers.isolation_forest(scaled, train, FEATURES, ["user", "day"], _KEEP)


@query("local_outlier_factor")
def local_outlier_factor(spark, sf_dir):
    scaled, train = scaled_grid(spark, sf_dir)
    return outliers.local_outlier_factor(scaled, train, FEATURES, ["user", "day"], _KEEP)


# A stand-in score that SQL can repeat: the squared distance from the training mean.
_DISTANCE_SQL = f"""os AS (SELECT "user", day, label, {' + '.join(f'{f} * {f}' for f in FEATURES)} AS outlier
  FROM (SELECT g."user", g.day, g.label, {_SCALED} FROM grid g)),
tr AS (SELECT list_sort(list(outlier)) AS v, (count(*) - 1) * (1.0 - greatest(avg(label), 0.005)) AS h
  FROM os WHERE day < {SPLIT}),
cut AS (SELECT v[CAST(floor(h) AS BIGINT) + 1] * (1 - (h - floor(h)))
  + v[CAST(ceil(h) AS BIGINT) + 1] * (h - floor(h)) AS c FROM tr)"""


def distance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled, _ = scaled_grid(spark, sf_dir)
    total = sum((F.col(f) * F.col(f) for f in FEATURES[1:]), F.col(FEATURES[0]) * F.col(FEATURES[0]))
    return scaled.select("user", "day", "label", total.alias("outlier"))


@query(
    "global_user_scores",
    _with(
        f"""SELECT "user", round(max(outlier), 4) AS risk, CAST(sum(CASE WHEN outlier > c THEN 1 ELSE 0 END) AS BIGINT) AS alarms
        FROM os, cut WHERE day >= {SPLIT} GROUP BY "user\"""",
        GRID_SQL, _DISTANCE_SQL,
    ),
)
def global_user_scores(spark, sf_dir):
    """Peak score and number of alarmed days per user, on a score SQL can repeat."""
    scored = distance_scores(spark, sf_dir)
    alarms = outliers.outlier_alarms(scored, SPLIT).groupBy("user").agg(F.sum("alarm").alias("alarms"))
    risks = outliers.global_user_scores(scored, SPLIT)
    return risks.join(alarms, "user").select("user", F.round("risk", 4).alias("risk"), "alarms")


@query("compare_insider_rankings")
def compare_insider_rankings(spark, sf_dir):
    """Ranking metrics of the adaptive profile and of the population scores."""
    scaled, train = scaled_grid(spark, sf_dir)
    scored = scored_days(spark, sf_dir).persist()
    labels = profiles.user_label(scored).persist()
    risks = {
        "profile": profiles.user_risk(scored, SPLIT),
        "isolation_forest": outliers.global_user_scores(
            outliers.isolation_forest(scaled, train, FEATURES, ["user", "day"], _KEEP), SPLIT
        ),
        "lof": outliers.global_user_scores(
            outliers.local_outlier_factor(scaled, train, FEATURES, ["user", "day"], _KEEP), SPLIT
        ),
    }
    out = None
    for method, risk in risks.items():
        ranked = metrics.ranking_metrics(risk.join(labels, "user").persist(), "risk", "label", "user")
        part = ranked.withColumn("method", F.lit(method))
        out = part if out is None else out.unionByName(part)
    return out.select("method", "metric", "value")


# --- streaming twins ---------------------------------------------------------------------------


@query(
    "stream_user_day_features",
    _with(
        f"""SELECT "user", CAST(date AS VARCHAR) AS date, {_DAY_COLUMNS} FROM ud
        WHERE date < (SELECT CAST(max(ts) - INTERVAL 1 DAY AS DATE) FROM base)""",
        DAYS_SQL,
    ),
)
def stream_user_day_features(spark, sf_dir):
    """Days the watermark has closed, from one audit stream in two runs."""
    rows = None
    wanted = ["log", "ts", "user", "pc", "activity", "filename", "to", "cc", "bcc", "size"]
    for name, log in audit_logs(spark, sf_dir).items():
        part = log.withColumn("log", F.lit(name))
        part = part.select(*[F.col(c) if c in part.columns else F.lit(None).cast("string").alias(c) for c in wanted])
        rows = part if rows is None else rows.unionByName(part)
    # Event time in streaming is an instant; the session zone is UTC.
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    split = (F.to_date("ts") > F.lit("2024-01-15").cast("date")).cast("int")
    found = jobs.replay(spark, rows, split, 2, jobs.stream_user_day_features, "user-days")
    return _shown(found)


@query(
    "stream_profile_scores",
    _with(
        'SELECT "user", day, ' + ", ".join(f"round(z_{f}, 4) AS z_{f}" for f in FEATURES) + " FROM z", SCORES_SQL
    ),
)
def stream_profile_scores(spark, sf_dir):
    """The grid in three runs of days; equals the batch scores."""
    cells = grid(spark, sf_dir).select("user", "day", *FEATURES)
    split = F.least(F.floor(F.col("day") / 8), F.lit(2)).cast("int")

    def build(stream):
        return jobs.stream_profile_scores(stream, RHO, WARMUP, FEATURES)

    found = jobs.replay(spark, cells, split, 3, build, "profiles")
    return found.select("user", "day", *[F.round(f"z_{f}", 4).alias(f"z_{f}") for f in FEATURES])
