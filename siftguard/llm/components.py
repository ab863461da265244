"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftguard.session import materialize


def components(links: DataFrame) -> DataFrame:
    """Smallest id reachable by links, for every id that has one.

    ``links`` has longs ``a`` and ``b``. Large-star and small-star rounds: every node's
    neighbours move to its smallest neighbour, until each component is a star around its
    smallest id. Rounds grow with the logarithm of the longest chain. Work per round is two
    aggregations by node; a node with many neighbours is pre-aggregated, its rows never meet.

    Returns ``id``, ``component_id``. Nulls and self-links are dropped; repeated links are
    harmless; an empty table gives an empty table.
    """
    edges = materialize(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.filter("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.distinct(), "large-star")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(
            F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")
        )
        edges = materialize(small.filter("a <> b").distinct(), "small-star")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    centres = edges.select(F.col("b").alias("id")).distinct().withColumn("component_id", F.col("id"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(centres)
