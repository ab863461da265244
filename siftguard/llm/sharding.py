"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Keys hash to cells of a ring; a cell belongs to the next virtual node clockwise. Shards have a
capacity; when a shard is full, keys go on clockwise to the next shard with room. What a cell
sends where depends only on how many keys the cells have, so the walk runs over these counts
(a table of fixed size), and each key finds its place by its rank in its cell.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftguard.session import spread

CELLS = 1 << 14


class Ring:
    """Shards in clockwise order from every cell."""

    def __init__(self, shards: int, nodes: int = 64, cells: int = CELLS, seed: str = "ring"):
        points = sorted(
            (xxhash.xxh3_64_intdigest(f"{seed}:{shard}:{node}"), shard) for shard in range(shards) for node in range(nodes)
        )
        places = np.array([p % 2**64 * cells >> 64 for p, _ in points])
        owners = [shard for _, shard in points]
        self.shards, self.cells = shards, cells
        self._next = np.searchsorted(places, np.arange(cells)) % len(points)
        self._walks: list[list[int]] = []
        for i in range(len(points)):
            self._walks.append(list(dict.fromkeys(owners[i:] + owners[:i])))
        # Cells are served in a seeded order, so that no part of the ring fills up first.
        self.order = sorted(range(cells), key=lambda c: xxhash.xxh3_64_intdigest(f"{seed}:cell:{c}"))

    def walk(self, cell: int) -> list[int]:
        return self._walks[self._next[cell]]

    def assign(self, counts: dict[int, int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
        """(cell, first rank, rank after the last, shard, slot of the first) of all keys."""
        used, out = [0] * self.shards, []
        for cell in self.order:
            at, n = 0, counts.get(cell, 0)
            for shard in self.walk(cell):
                if at == n:
                    break
                take = min(n - at, capacity[shard] - used[shard])
                if take > 0:
                    out.append((cell, at, at + take, shard, used[shard]))
                    used[shard] += take
                    at += take
            if at < n:
                raise ValueError("the shards cannot hold all keys")
        return out


def capacities(rows: int, shards: int, slack: float | None = None) -> list[int]:
    """Rows that each shard may hold: as even as can be, or up to 1 + slack times the mean."""
    if slack is None:
        return [rows // shards + (shard < rows % shards) for shard in range(shards)]
    return [-(-int(rows * (1 + slack)) // shards)] * shards


def shard_rows(docs: DataFrame, shards: int = 40, nodes: int = 64, slack: float | None = None, cells: int = CELLS) -> DataFrame:
    """Place every document in a shard.

    Returns, per input row, doc_id, size (UTF-8 bytes and 16), text_crc32, law, shard, slot
    (gapless from 0 within a shard) and grown_shard (null). Without ``slack`` the capacities
    add up to the number of rows, so the law ``rows`` holds: counts differ by one at most.
    With slack a shard has up to 1 + slack times the mean, and fewer keys move when rows or
    shards are added. A null text is empty; a document without an id is placed by its text.
    Rows that repeat an id share a cell; equal rows may swap slots. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    keyed = spread(docs.select("doc_id", "text")).select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(F.coalesce("doc_id", -1 - F.crc32(text))).alias("key"),
    ).withColumn("cell", F.pmod("key", F.lit(cells)).cast("int"))
    # Apart, so that counting reads texts only of rows without an id.
    counted = keyed.filter("doc_id is not null").select(F.pmod(F.xxhash64("doc_id"), F.lit(cells)).cast("int").alias("cell"))
    counted = counted.union(keyed.filter("doc_id is null").select("cell")).groupBy("cell").count()
    counts = {r["cell"]: r["count"] for r in counted.collect()}
    ring = Ring(shards, nodes, cells)
    segments = ring.assign(counts, capacities(sum(counts.values()), shards, slack))
    # At most one segment per cell and one more per shard.
    places = spark.createDataFrame(segments, "cell int, low long, high long, shard int, slot long")
    ranked = keyed.withColumn(
        "rank", F.row_number().over(Window.partitionBy("cell").orderBy("key", "doc_id", "text_crc32", "size")) - 1
    )
    return ranked.join(F.broadcast(places), "cell").filter("low <= rank and rank < high").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law") if slack is None else F.lit("bounded").alias("law"),
        "shard", (F.col("slot") + F.col("rank") - F.col("low")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
