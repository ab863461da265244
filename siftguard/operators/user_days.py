"""User-day behaviour features from four audit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Feature order.
FEATURES = [
    "logons", "logon_afterhours", "logon_weekend", "n_pc", "usb_connects", "usb_afterhours",
    "file_copies", "file_exe_zip", "emails", "email_external", "email_bytes",
]
_SUMMED = [f for f in FEATURES if f != "n_pc"]

HOME_DOMAIN = "dtaa.com"
ARCHIVE_SUFFIX = r"\.(exe|zip|rar|7z)\z"


def after_hours(ts: Column) -> Column:
    """Before 7:00 or from 19:00 on."""
    return (F.hour(ts) < 7) | (F.hour(ts) >= 19)


def on_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def has_external_recipient(domain: str = HOME_DOMAIN) -> Column:
    """At least one address in to, cc or bcc outside the domain."""
    joined = F.concat_ws(";", F.col("to"), F.col("cc"), F.col("bcc"))
    return F.exists(
        F.split(joined, ";"), lambda a: (a != "") & ~F.contains(F.lower(a), F.lit(domain))
    )


def _one(cond: Column) -> Column:
    return F.coalesce(cond.cast("double"), F.lit(0.0))


def _events(log: DataFrame, measures: dict[str, Column], pc: Column | None = None) -> DataFrame:
    """Narrow projection of a log to (user, date, measures, pc)."""
    return log.filter(F.col("ts").isNotNull()).select(
        F.col("user").cast("string").alias("user"),
        F.to_date("ts").alias("date"),
        *[measures.get(f, F.lit(0.0)).cast("double").alias(f) for f in _SUMMED],
        (pc if pc is not None else F.lit(None)).cast("string").alias("pc"),
    )


def user_day_features(
    logon: DataFrame, device: DataFrame, file: DataFrame, email: DataFrame
) -> DataFrame:
    """One row per (user, date) with any activity.

    The logs are projected to a common narrow shape and aggregated once: partial sums
    on the map side, one shuffle by (user, date) and one by (user, date, pc) for the
    distinct count. A day with disconnects only makes no row.
    """
    ts = F.col("ts")
    is_logon = F.col("activity") == "Logon"
    parts = [
        _events(
            logon,
            {
                "logons": _one(is_logon),
                "logon_afterhours": _one(is_logon & after_hours(ts)),
                "logon_weekend": _one(is_logon & on_weekend(ts)),
            },
            F.col("pc"),
        ),
        _events(
            device.filter(F.col("activity") == "Connect"),
            {"usb_connects": F.lit(1.0), "usb_afterhours": _one(after_hours(ts))},
        ),
        _events(
            file,
            {
                "file_copies": F.lit(1.0),
                "file_exe_zip": _one(F.lower("filename").rlike(ARCHIVE_SUFFIX)),
            },
        ),
        _events(
            email,
            {
                "emails": F.lit(1.0),
                "email_external": _one(has_external_recipient()),
                "email_bytes": F.coalesce(F.col("size").try_cast("double"), F.lit(0.0)),
            },
        ),
    ]
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    days = together.groupBy("user", "date").agg(
        *[F.sum(f).alias(f) for f in _SUMMED],
        F.count_distinct("pc").cast("double").alias("n_pc"),
    )
    return days.select("user", "date", *FEATURES)


def label_user_days(days: DataFrame, malicious: DataFrame) -> DataFrame:
    """1 if the (user, date) is malicious; insider days are few, AQE broadcasts them."""
    marked = malicious.select(
        F.col("user").cast("string").alias("user"), "date", F.lit(1).alias("label")
    )
    return days.join(marked, ["user", "date"], "left").withColumn(
        "label", F.coalesce("label", F.lit(0))
    )


def user_day_summary(labelled: DataFrame) -> DataFrame:
    return labelled.agg(
        F.count(F.lit(1)).alias("user_days"),
        F.sum("label").alias("malicious"),
        F.count_distinct("user").alias("users"),
    )


def user_day_grid(labelled: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Every user on every observed date, zeros where nothing happened.

    The calendar is one array (one entry per observed date) exploded per user, so
    the grid needs no join of users with dates; the one join is by (user, date).
    """
    calendar = labelled.agg(F.array_sort(F.collect_set("date"))).scalar()
    cells = (
        labelled.select("user").distinct()
        .select("user", F.posexplode(calendar).alias("day", "date"))
    )
    filled = cells.join(labelled.select("user", "date", *features, "label"), ["user", "date"], "left")
    return filled.select(
        "user", "date", "day",
        *[F.coalesce(f, F.lit(0.0)).alias(f) for f in features],
        F.coalesce("label", F.lit(0)).alias("label"),
    )
