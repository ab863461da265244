"""Ordered computations that stay parallel when one key holds most of the rows.

A plain window over ``partitionBy(key)`` puts a whole key into one task. Here each
key is cut into buckets that follow the order; totals per bucket are combined in a
small table, and only rows of one bucket meet in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftguard.session import materialize

_FOLD = {"sum": F.sum, "max": F.max}


def _combine(fn: str, a: Column, b: Column) -> Column:
    if fn == "max":
        return F.greatest(a, b)
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def running(
    df: DataFrame,
    keys: list[str],
    bucket: Column,
    order: list,
    folds: dict[str, tuple[str, Column]],
) -> DataFrame:
    """Inclusive running folds per key along ``order``.

    ``bucket`` must be a whole number that never falls along the order, with a
    bounded number of rows per key and bucket. ``folds`` maps an output column to
    ("sum" or "max", value column). The input is read twice, for the bucket totals and
    for the rows: cache or write it first if it is expensive.
    """
    kinds = {name: fn for name, (fn, _) in folds.items()}
    tagged = df.select(
        "*", bucket.cast("long").alias("__bucket"), *[col.alias(name) for name, (_, col) in folds.items()]
    )
    totals = tagged.groupBy(*keys, "__bucket").agg(*[_FOLD[fn](c).alias(c) for c, fn in kinds.items()])
    # One row per bucket: a hundred-thousandth of the rows with the default widths.
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *keys, "__bucket", *[_FOLD[fn](c).over(earlier).alias(f"{c}_before") for c, fn in kinds.items()]
    )
    local = (
        Window.partitionBy(*keys, "__bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # Null-safe: a missing key or bucket is one like any other.
    sums = before.select(*[F.col(c).alias(f"__of_{c}") for c in (*keys, "__bucket")], *[f"{c}_before" for c in kinds])
    met = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in (*keys, "__bucket")])
    windowed = tagged.join(sums, met).select(
        *df.columns,
        *[F.col(f"{c}_before") for c in kinds],
        *[_FOLD[fn](c).over(local).alias(c) for c, fn in kinds.items()],
    )
    return windowed.select(
        *df.columns, *[_combine(fn, F.col(c), F.col(f"{c}_before")).alias(c) for c, fn in kinds.items()]
    )


def stream_positions(
    df: DataFrame, stream: str, order_id: str, width: int = 100_000, out: str = "pos", ties: tuple[str, ...] = ()
) -> DataFrame:
    """0-based position of each row in its stream, by a whole-number id.

    A bucket of ``width`` unique ids holds at most ``width`` rows, whatever the skew. Where
    ids are sparse, buckets are cut at quantiles instead, so that they hold rows as well; the
    range of the ids is looked up when this is called. If an id can repeat, ``ties`` must name
    the columns that settle the order; otherwise positions could differ between runs.
    """
    n, low, high = df.agg(F.count(order_id), F.min(order_id), F.max(order_id)).first()
    bucket = F.floor(F.col(order_id) / F.lit(width))
    if n and high - low > 8 * max(n, width):
        bucket = quantile_bucket(df, order_id, width)
    ranked = running(df, [stream], bucket, [order_id, *ties], {out: ("sum", F.lit(1).cast("long"))})
    return ranked.withColumn(out, F.col(out) - 1)


def hash_rank(
    df: DataFrame, keys: list[str], hash_col: str, prefix: int | None = None, out: str = "rank",
    rows_per_bucket: int = 25_000,
) -> DataFrame:
    """1-based rank by a hexadecimal hash, bucketed by its first ``prefix`` digits.

    Without a prefix the rows are counted at once, and the number of digits follows them.
    """
    if prefix is None:
        wanted, prefix = -(-df.count() // rows_per_bucket), 1
        while 16**prefix < wanted:
            prefix += 1
    bucket = F.conv(F.substring(hash_col, 1, prefix), 16, 10)
    return running(df, keys, bucket, [hash_col], {out: ("sum", F.lit(1).cast("long"))})


def quantile_bucket(df: DataFrame, column: str, rows_per_bucket: int = 100_000) -> Column:
    """Bucket number along a numeric column; the number of buckets follows the rows.

    Pre-aggregate on the column first, so that a frequent value is one row. A row is
    compared with coarse cuts, then with the fine cuts of its range. Counts the rows and
    takes the cuts when it is called.
    """
    buckets = max(8, -(-df.count() // rows_per_bucket))
    points = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(df.stat.approxQuantile(column, points, 0.25 / buckets)))
    if not cuts:
        return F.lit(0).cast("long")
    fan = 64
    groups = [cuts[i: i + fan] for i in range(0, len(cuts), fan)]

    def below(points: Column) -> Column:
        return F.size(F.filter(points, lambda p: p < F.col(column)))

    def literal(values: list[float]) -> Column:
        return F.array(*[F.lit(float(v)) for v in values])

    if len(groups) == 1:
        return below(literal(cuts)).cast("long")
    # The group whose last cut is not below the value; the last group takes the rest.
    group = F.least(below(literal([g[-1] for g in groups])), F.lit(len(groups) - 1))
    fine = F.array(*[literal(g) for g in groups])[group]
    return (group * fan + below(fine)).cast("long")


def trailing_mean(
    df: DataFrame,
    keys: list[str],
    pos: str,
    value: str,
    window: int,
    out: str,
    block: int = 100_000,
) -> DataFrame:
    """Mean of the last ``window`` rows up to each row, shorter at the start.

    Blocks of positions are independent: each gets a copy of the last
    ``window - 1`` rows of the block before it.
    """
    block = max(block, window)
    home = F.floor(F.col(pos) / F.lit(block)).cast("long")
    reaches_next = F.col(pos) % block > block - window
    homes = F.when(reaches_next, F.array(home, home + 1)).otherwise(F.array(home))
    frame = Window.partitionBy(*keys, "__block").orderBy(pos).rowsBetween(-(window - 1), 0)
    return (
        df.select("*", F.explode(homes).alias("__block"))
        .withColumn(out, F.avg(value).over(frame))
        .filter(F.col("__block") == home)
        .drop("__block")
    )


def percentiles(df: DataFrame, keys: list[str], value: str, points: list[float]) -> DataFrame:
    """Exact interpolated percentiles per key, as the array ``cuts``; NULL values do not count.

    Equal values are counted first. A running sum over value buckets gives each value its
    span of ranks; the two values around a wanted rank are picked by a small aggregate, so no
    task holds a key's values.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    counts = materialize(counts, "value-counts")
    upto = running(counts, keys, quantile_bucket(counts, "__v"), ["__v"], {"__upto": ("sum", F.col("__c"))})
    totals = counts.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    met = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys], F.lit(True))
    named = totals.select(*[F.col(k).alias(f"__of_{k}") for k in keys], "__n")
    ranked = upto.join(named, met)
    aggs = []
    for p in points:
        # Ranks from 0: the wanted one lies between two whole ranks.
        rank = F.lit(float(p)) * (F.col("__n") - 1)
        low, high = F.floor(rank), F.ceil(rank)
        first = F.col("__upto") - F.col("__c")
        at = lambda r: F.max(F.when((first <= r) & (r < F.col("__upto")), F.col("__v")))
        a, b, part = at(low), at(high), F.max(rank - low)
        aggs.append(a + (b - a) * part)
    return ranked.groupBy(*keys).agg(F.array(*aggs).alias("cuts"))
