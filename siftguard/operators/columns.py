"""Statistics of many columns in long form.

A table of hundreds of mostly empty columns becomes (column, value) pairs without the zeros.
Zeros are what is missing to the number of rows, so every statistic is an aggregate of a few
expressions by column, whatever the number of columns. The driver sees some numbers per column.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Quantiles that the sketch of a column gives, and its error in ranks: far below a step.
GRID = [i / 100 for i in range(101)]
ACCURACY = 10_000


def column_pairs(df: DataFrame, columns: list[str], *carry: Column) -> DataFrame:
    """f (number of the column) and v of every value but zeros; NULL and NaN stand among them."""
    every = F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])
    kept = F.filter(every, lambda x: x["v"].isNull() | (x["v"] != 0))
    return df.select(*carry, F.explode(kept).alias("x")).select("*", "x.f", "x.v").drop("x")


def sketch(value: Column) -> Column:
    """Mergeable sketch of a column's values, as its quantiles along the grid."""
    return F.percentile_approx(value, F.array(*[F.lit(p) for p in GRID]), F.lit(ACCURACY))


@dataclass
class Counted:
    """What is known of a column: pairs, negative ones among them, zeros, and the sketch of the pairs."""

    f: int
    pairs: int
    below: int
    zeros: int
    grid: list[float] | None

    @property
    def n(self) -> int:
        return self.pairs + self.zeros

    def among_pairs(self, rank: int) -> int | None:
        """Rank among the pairs of a rank among all values; none if it falls on a zero."""
        if rank < self.below:
            return rank
        return rank - self.zeros if rank >= self.below + self.zeros else None

    def bracket(self, rank: int) -> tuple[float | None, float | None]:
        """Values that the one at a rank lies between; open at the ends, where a sketch may miss values."""
        last = len(GRID) - 1
        low, high = floor(rank * last / self.pairs) - 1, ceil((rank + 1) * last / self.pairs) + 1
        return (self.grid[low] if low > 0 else None), (self.grid[high] if high < last else None)


def ranked_values(pairs: DataFrame, columns: list[Counted], wanted: set[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """Values at (f, rank); ranks from 0 among the pairs of a column.

    ``pairs`` has f and v without NULL. The sketch gives every rank a bracket of some hundredths of
    the column; one pass counts what lies below and ranks what lies inside, so the value is exact.
    """
    if not wanted:
        return {}
    known = {c.f: c for c in columns}
    brackets = pairs.sparkSession.createDataFrame(
        [(f, rank, *known[f].bracket(rank)) for f, rank in sorted(wanted)], "f int, rank long, lo double, hi double"
    )
    # A few rows per column are broadcast.
    placed = pairs.join(F.broadcast(brackets), "f").filter("hi is null or v <= hi")
    inside = F.expr("lo is null or v >= lo")
    counts = placed.select("f", "rank", inside.alias("inside"), F.when(inside, F.col("v")).alias("v")).groupBy(
        "f", "rank", "inside", "v"
    ).agg(F.count("*").alias("c"))
    along = Window.partitionBy("f", "rank").orderBy("inside", "v").rowsBetween(Window.unboundedPreceding, 0)
    met = counts.withColumn("upto", F.sum("c").over(along)).filter("inside and upto > rank")
    return {(r["f"], r["rank"]): r["value"] for r in met.groupBy("f", "rank").agg(F.min("v").alias("value")).collect()}


def quantiles(pairs: DataFrame, columns: list[Counted], points: list[float], lower: bool = False) -> dict[int, list[float]]:
    """Exact quantiles of every column that has values.

    Values between two ranks are interpolated; with ``lower`` the smallest value that the
    share of values reaches is taken.
    """
    spots = {
        (c.f, p): max(ceil(c.n * p) - 1, 0) if lower else p * (c.n - 1) for c in columns if c.n for p in points
    }
    known = {c.f: c for c in columns}
    ranks = {(f, r) for (f, _), spot in spots.items() for r in (floor(spot), ceil(spot))}
    among = {(f, r): known[f].among_pairs(r) for f, r in ranks}
    found = ranked_values(pairs, columns, {(f, k) for (f, _), k in among.items() if k is not None})
    at = lambda f, r: 0.0 if among[f, r] is None else found[f, among[f, r]]

    def cut(f: int, spot: float) -> float:
        a = at(f, floor(spot))
        return a + (at(f, ceil(spot)) - a) * (spot - floor(spot))

    return {c.f: [cut(c.f, spots[c.f, p]) for p in points] for c in columns if c.n}
