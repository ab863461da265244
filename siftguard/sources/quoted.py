"""Records of CSV files whose quoted fields may hold line breaks, read in splits.

A line break ends a record only where the quotes before it are even in number. Lines are
read in splits; a running count inside a split and the parities of the splits before it say
which lines stand inside a field. Only such lines and the ones they belong to are shuffled
a second time, to be put together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftguard.session import materialize


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its split, its place, its quotes, and the parity of the quotes before it in the split.

    A split is at most ``spark.sql.files.maxPartitionBytes`` long, and so is a window.
    """
    scan = spark.read.option("lineSep", "\n").text(path)
    lines = scan.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"),
        (F.length("value") - F.length(F.replace("value", F.lit('"')))).cast("long").alias("quotes"),
    )
    order = Window.partitionBy("file", "split").orderBy("at")
    before = F.coalesce(F.sum("quotes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.select(
        "*", (before % 2).alias("before"), ((F.row_number().over(order) == 1) & (F.col("split") == 0)).alias("header")
    )


def _splits(lines: DataFrame) -> DataFrame:
    """Per split: the parity it begins with, and the record that is open at its beginning.

    One row per split of a file, so the window over a file is small.
    """
    odd_line = F.col("quotes") % 2 == 1
    per_split = lines.groupBy("file", "split").agg(
        F.sum("quotes").alias("quotes"),
        F.count_if(odd_line & (F.col("before") == 0)).alias("if_even"),
        F.count_if(odd_line & (F.col("before") == 1)).alias("if_odd"),
    )
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    entered = per_split.withColumn("entry", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    opened = entered.withColumn("opened", F.when(F.col("entry") == 0, F.col("if_even")).otherwise(F.col("if_odd")))
    return opened.select(
        "file", "split", "entry",
        F.last(F.when(F.col("opened") > 0, F.struct(F.col("split").alias("home"), F.col("opened").alias("number"))), True)
        .over(earlier).alias("open"),
    )


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """One row ``record`` per CSV record; the first line of each file, its header, is left out.

    Quotes must be balanced, as the format asks for (a quote in a field is written twice and
    the field quoted): after a stray quote, records and line breaks change places up to the
    next one. Blank lines between records are no records. A record whose closing quote is
    missing reaches to the end of its file. Carriage returns at the end of a record are
    dropped, in fields they stay. The lines are written once to the shared folder, as each
    split has to know all splits before it.
    """
    lines = materialize(_lines(spark, path), "quoted-lines")
    placed = lines.join(_splits(lines), ["file", "split"])
    inside = F.col("before") != F.col("entry")
    odd = F.col("quotes") % 2 == 1
    whole = placed.filter(~inside & ~odd & ~F.col("header")).select(F.col("line").alias("record"))
    # A piece is numbered by the records opened so far in its split; the first ones may
    # belong to a record of an earlier split.
    order = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = placed.filter((inside | odd) & ~F.col("header")).withColumn(
        "number", F.sum((odd & ~inside).cast("long")).over(order)
    )
    carried = F.col("number") == 0
    joined = (
        pieces.select(
            "file",
            F.when(carried, F.col("open.home")).otherwise(F.col("split")).alias("home"),
            F.when(carried, F.col("open.number")).otherwise(F.col("number")).alias("number"),
            F.struct("split", "at", "line").alias("piece"),
        )
        .groupBy("file", "home", "number")
        .agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
        .select(F.array_join(F.col("pieces.line"), "\n").alias("record"))
    )
    records = whole.unionByName(joined).select(F.regexp_replace("record", r"\r\z", "").alias("record"))
    return records.filter(F.trim("record") != "")
