"""Readers for the audit logs, corpora and streams, and the result sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftguard.sources.quoted import quoted_records

TIME_FORMAT = "MM/dd/yyyy HH:mm:ss"

# Column order of the log files.
LOG_COLUMNS = {
    "logon": ["id", "date", "user", "pc", "activity"],
    "device": ["id", "date", "user", "pc", "activity"],
    "file": ["id", "date", "user", "pc", "filename", "content"],
    "email": [
        "id", "date", "user", "pc", "to", "cc", "bcc", "from", "size", "attachments", "content",
    ],
}
# Rows with fewer fields than this are dropped.
_LEAST_FIELDS = {"logon": 5, "device": 5, "file": 5, "email": 9}


def _schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target))


def read_log(spark: SparkSession, path: str, name: str, multi_line: bool = True) -> DataFrame:
    """One log with a parsed time ``ts``; rows with too few fields are dropped.

    Quoted fields may hold commas, quotes and line breaks; files are split, and records are
    cut by the parity of quotes (see :func:`quoted_records`). Where every record is known to
    be one line, ``multi_line=False`` saves the pass that looks for the ends of records.
    """
    columns = LOG_COLUMNS[name]
    options = {
        "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_raw", "multiLine": str(multi_line).lower(),
    }
    schema = _schema([*columns, "_raw"])
    if multi_line:
        parsed = F.from_csv("record", schema.toDDL(), options)
        raw = quoted_records(spark, path).select(parsed.alias("r")).select("r.*")
    else:
        raw = spark.read.schema(schema).options(header=True, columnPruning=False, **options).csv(path)
    # `_raw` is filled when the number of fields differs from the schema.
    # Possessive, as a field may be long: the pattern never steps back into it.
    unquoted = F.regexp_replace("_raw", r'"(?:[^"]++|"")*+"', "")
    fields = F.size(F.split(unquoted, ",", -1))
    # Never true of itself, but keeps a data column in a scan that only counts rows.
    read = F.coalesce(F.length(columns[0]), F.lit(0)) < 0
    complete = F.col("_raw").isNull() | (fields >= _LEAST_FIELDS[name]) | read
    return _with_time(raw.filter(complete).drop("_raw"))


def _with_time(raw: DataFrame) -> DataFrame:
    return raw.withColumn("ts", F.try_to_timestamp("date", F.lit(TIME_FORMAT)).cast("timestamp_ntz"))


def read_audit_logs(
    spark: SparkSession, folders: list[str], multi_line: bool = True
) -> dict[str, DataFrame]:
    """The four logs, each from the first folder that has it.

    A missing log is an empty table. Rows whose time does not parse keep a NULL
    ``ts`` and are listed by :func:`rejected_rows`.
    """
    logs = {}
    for name, columns in LOG_COLUMNS.items():
        path = next((f"{d}/{name}.csv" for d in folders if _exists(spark, f"{d}/{name}.csv")), None)
        if path:
            logs[name] = read_log(spark, path, name, multi_line)
        else:
            logs[name] = _with_time(spark.createDataFrame([], _schema(columns)))
    return logs


def accepted_rows(log: DataFrame) -> DataFrame:
    return log.filter(F.col("ts").isNotNull())


def rejected_rows(log: DataFrame) -> DataFrame:
    """Rows whose time stamp does not parse."""
    return log.filter(F.col("ts").isNull())


def read_insider_intervals(spark: SparkSession, path: str, dataset: str = "4.2") -> DataFrame:
    """Insider intervals of one dataset version: user, start, end."""
    raw = (
        spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    )
    times = [
        F.try_to_timestamp(c, F.lit(TIME_FORMAT)).cast("timestamp_ntz").alias(c) for c in ("start", "end")
    ]
    return raw.filter(F.col("dataset") == dataset).select("user", *times)


MASK_SCHEMA = (
    "doc_id long, source_text string, language string, "
    "privacy_mask array<struct<label:string,value:string,start:int,end:int>>"
)


def read_mask_corpus(spark: SparkSession, path: str, language: str = "en") -> DataFrame:
    """Annotated documents of one language from JSON lines."""
    return spark.read.schema(MASK_SCHEMA).json(path).filter(F.col("language") == language)


def numeric_stream(
    rows: DataFrame,
    stream: str,
    pos: str,
    features: list[str],
    label: str,
    max_n: int | None = None,
) -> DataFrame:
    """(stream_id, pos, features, y): features in field order, dense class index.

    Class numbers come from the small table of distinct labels per stream.
    """
    kept = rows if max_n is None else rows.filter(F.col(pos) < max_n)
    classes = (
        kept.groupBy(F.col(stream).alias("stream_id"))
        .agg(F.array_sort(F.collect_set(label)).alias("classes"))
    )
    shaped = kept.select(
        F.col(stream).alias("stream_id"),
        F.col(pos).cast("long").alias("pos"),
        F.array(*[F.col(f).cast("double") for f in features]).alias("features"),
        F.col(label).alias("__label"),
    )
    return shaped.join(classes, "stream_id").select(
        "stream_id", "pos", "features",
        (F.array_position("classes", F.col("__label")) - 1).cast("int").alias("y"),
    )


def change_points_before(points: DataFrame, max_n: int | None) -> DataFrame:
    """Change points inside the kept part of a stream."""
    return points if max_n is None else points.filter(F.col("cp_pos") < max_n)


def long_results(df: DataFrame, experiment: str, dataset: Column, method: Column, metrics: list[str]) -> DataFrame:
    """Long result table: experiment, dataset, method, metric, value."""
    pairs = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    )
    return df.select(
        F.lit(experiment).alias("experiment"), dataset.alias("dataset"), method.alias("method"),
        F.explode(pairs).alias("p"),
    ).select("experiment", "dataset", "method", "p.metric", "p.value")


def write_results(results: DataFrame, path: str, kind: str = "json") -> None:
    """Store a long result table, one folder per experiment; other experiments stay."""
    writer = results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("experiment")
    if kind == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        writer.parquet(path)


def read_results(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    schema = "experiment string, dataset string, method string, metric string, value double"
    return spark.read.schema(schema).format(kind).load(path).select(
        "experiment", "dataset", "method", "metric", "value"
    )
