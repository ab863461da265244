"""Shared inputs of the registered queries, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftguard.operators.running import stream_positions
from siftguard.session import ship_package, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, if there is one, its SQL twin."""

    def add(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Document columns, spread over the cores if the files are few."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *columns))


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# --- events as numeric streams -------------------------------------------------

WINDOW, STEP, WARM = 100, 25, 300
FEATURES_PER_STREAM = 3


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("int")
    )


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream per event type; the value triples in every other thousand rows.

    Kept in the cache: positions cost a pass of their own, and most queries read the
    stream more than once.
    """
    rows = event_rows(spark, sf_dir).select("event_id", F.col("event_type").alias("stream_id"), "value", "ts", "k")
    placed = stream_positions(rows, "stream_id", "event_id")
    shifted = F.when(F.floor(F.col("pos") / 1000) % 2 == 1, F.col("value") * 3).otherwise(F.col("value"))
    return placed.select(
        "stream_id", "pos",
        F.array(shifted, F.hour("ts").cast("double"), F.col("k").cast("double")).alias("features"),
        (F.col("value") > 30).cast("int").alias("y"),
    ).persist(StorageLevel.MEMORY_AND_DISK)


def change_points(stream: DataFrame) -> DataFrame:
    """Every thousandth row of a stream."""
    lengths = stream.groupBy("stream_id").agg(F.max("pos").alias("last"))
    points = F.sequence(F.lit(1000).cast("long"), F.greatest("last", F.lit(1000)), F.lit(1000).cast("long"))
    return (
        lengths.select("stream_id", "last", F.explode(points).alias("cp_pos"))
        .filter(F.col("cp_pos") <= F.col("last"))
        .select("stream_id", (F.col("cp_pos") / 1000).cast("long").alias("cp_order"), "cp_pos")
    )


STREAM_SQL = """
ev AS (
  SELECT event_type AS stream_id, event_id,
         row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos,
         value, hour(ts) AS h, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k
  FROM events),
st AS (
  SELECT stream_id, pos,
         CASE WHEN (pos // 1000) % 2 = 1 THEN value * 3 ELSE value END AS f0,
         CAST(h AS DOUBLE) AS f1, CAST(k AS DOUBLE) AS f2,
         CASE WHEN value > 30 THEN 1 ELSE 0 END AS y
  FROM ev),
lng AS (
  SELECT stream_id, pos, 0 AS f, f0 AS v FROM st UNION ALL
  SELECT stream_id, pos, 1, f1 FROM st UNION ALL
  SELECT stream_id, pos, 2, f2 FROM st),
lens AS (SELECT stream_id, max(pos) + 1 AS n FROM st GROUP BY stream_id),
cps AS (
  SELECT stream_id, CAST(i AS BIGINT) AS cp_order, CAST(i * 1000 AS BIGINT) AS cp_pos
  FROM lens, range(1, 1000000) t(i) WHERE i * 1000 <= n - 1)
""".strip()


def stream_sql(body: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([STREAM_SQL, *more]) + "\n" + body
