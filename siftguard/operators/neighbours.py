"""Exact nearest neighbours: cells of a k-d tree, searched where their boxes lie in reach.

A tree grown on a sample cuts the points into cells. The distance to the k-th neighbour in one cell
bounds a query's search: it asks only the cells whose boxes come that near, and those answer with
points that near.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftguard.session import by_group, materialize

# Rows compared with a block at a time inside a task.
_CHUNK = 256
# Rows that the tree is grown on; they steer the search, not its result.
_SAMPLE = 50_000


def _vectors(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    x = table.column("x")
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return x.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _split(x: np.ndarray) -> tuple[int, float] | None:
    """Column and cut near the median that part the rows best; none if all are equal."""
    cut = np.sort(x, axis=0)[(len(x) - 1) // 2]
    # Where the median is the largest value, the cut goes below it.
    below = np.where(x < x.max(axis=0), x, -np.inf).max(axis=0)
    cut = np.minimum(cut, below)
    left = x <= cut
    n = left.sum(axis=0)
    usable = (n > 0) & (n < len(x))
    if not usable.any():
        return None
    inside = np.where(left, x, 0.0).sum(axis=0)
    gap = (x.sum(axis=0) - inside) / np.maximum(len(x) - n, 1) - inside / np.maximum(n, 1)
    f = int(np.argmax(np.where(usable, n * (len(x) - n) * gap**2, -1.0)))
    return f, float(cut[f])


@dataclass
class _Tree:
    """Nodes as arrays; a leaf has column -1 and its number as cut."""

    column: np.ndarray
    cut: np.ndarray
    child: np.ndarray

    @classmethod
    def grow(cls, x: np.ndarray, leaf_rows: float) -> _Tree:
        nodes: list[list] = [[]]
        leaves, todo = 0, [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            split = _split(x[rows]) if len(rows) > leaf_rows else None
            if split is None:
                nodes[at] = [-1, float(leaves), at]
                leaves += 1
                continue
            goes_left = x[rows, split[0]] <= split[1]
            nodes[at] = [*split, len(nodes)]
            todo += [(len(nodes), rows[goes_left]), (len(nodes) + 1, rows[~goes_left])]
            nodes += [[], []]
        return cls(*[np.array(c) for c in zip(*nodes)])

    def cells(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while (inner := self.column[at] >= 0).any():
            right = ~(x[rows, np.maximum(self.column[at], 0)] <= self.cut[at])
            at = np.where(inner, self.child[at] + right, at)
        return self.cut[at].astype(np.int32)


@dataclass
class _Cells:
    """Cells that hold points: number, copies, parts and the box around their points."""

    number: np.ndarray
    rows: np.ndarray
    parts: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def gaps(self, x: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Distance of every row to the boxes of some cells."""
        out = np.zeros((len(x), len(some)))
        for d in range(x.shape[1]):
            v = x[:, d, None]
            out += np.maximum(np.maximum(self.low[some, d] - v, v - self.high[some, d]), 0.0) ** 2
        return np.sqrt(out)

    def near(self, x: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of rows and of the cells in their reach. What cannot be compared is in reach."""
        apart = np.maximum(np.maximum(self.low - x.max(axis=0), x.min(axis=0) - self.high), 0.0)
        some = np.flatnonzero(~((apart**2).sum(axis=1) > far.max() ** 2))
        row, cell = np.nonzero(~(self.gaps(x, some) > far[:, None]))
        return row, some[cell]


def _place(tree: _Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("cell", pa.array(tree.cells(_vectors(batch))))

    return run


def _go_home(tree: _Tree, cells: _Cells, k: int):
    """Visits to the own cell or, if it holds too few points, to the nearest that does not."""
    large = np.flatnonzero(cells.rows > k * cells.parts)
    place = np.full(int(cells.number.max()) + 1, -1)
    place[cells.number[large]] = large

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch)
            own = tree.cells(x)
            home = np.where(own < len(place), place[np.minimum(own, len(place) - 1)], -1)
            lost = np.flatnonzero(home < 0)
            for i in range(0, len(lost), _CHUNK):
                rows = lost[i: i + _CHUNK]
                home[rows] = large[cells.gaps(x[rows], large).argmin(axis=1)]
            visits = batch.append_column("cell", pa.array(cells.number[home], pa.int32()))
            yield visits.append_column("part", pa.array(np.zeros(len(x)), pa.int32()))

    return run


def _go_near(cells: _Cells):
    """Visits to every part of the cells in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _CHUNK):
                some = batch.slice(start, _CHUNK)
                row, cell = cells.near(_vectors(some), some.column("far").to_numpy())
                parts = cells.parts[cell]
                first = np.repeat(np.cumsum(parts) - parts, parts)
                visits = some.take(pa.array(np.repeat(row, parts)))
                visits = visits.append_column("cell", pa.array(np.repeat(cells.number[cell], parts), pa.int32()))
                yield visits.append_column("part", pa.array(np.arange(len(first)) - first, pa.int32()))

    return run


def _nearest(x: np.ndarray, block: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k nearest rows of a block.

    A product of matrices picks somewhat more than k, whose distances are then taken exactly.
    """
    some = min(k + 16, len(block))
    squares = (block**2).sum(1)
    out_at, out_dist = [], []
    for i in range(0, len(x), _CHUNK):
        part = x[i: i + _CHUNK]
        rough = squares - 2.0 * part @ block.T
        at = np.argpartition(rough, some - 1, axis=1)[:, :some] if some < len(block) else np.tile(np.arange(some), (len(part), 1))
        at = np.sort(at, axis=1)
        dist = np.sqrt(((part[:, None, :] - block[at]) ** 2).sum(2))
        best = np.argsort(dist, axis=1, kind="stable")[:, :k]
        out_at.append(np.take_along_axis(at, best, 1))
        out_dist.append(np.take_along_axis(dist, best, 1))
    return np.concatenate(out_at), np.concatenate(out_dist)


def _candidates(left: pa.Table, right: pa.Table, k: int) -> tuple[np.ndarray, ...]:
    """Points, distances and copies of the k nearest of a block; a query leaves out one copy of itself."""
    right = right.sort_by("point")
    ids, names = right.column("point").to_numpy(), left.column("query").to_numpy()
    at, dist = _nearest(_vectors(left), _vectors(right), k + 1)
    found = ids[at]
    copies = right.column("weight").to_numpy()[at] - (found == names[:, None])
    return found, dist, np.clip(k - (np.cumsum(copies, axis=1) - copies), 0, copies)


def _reach(k: int):
    """How far a query has to look: to its k-th neighbour at home, or everywhere."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        far = np.full(left.num_rows, np.inf)
        if left.num_rows and right.num_rows:
            _, dist, n = _candidates(left, right, k)
            kth = np.where(n > 0, dist, 0.0).max(axis=1)
            far = np.where((n.sum(axis=1) >= k) & ~np.isnan(kth), kth * (1 + 1e-12) + 1e-9, np.inf)
        return left.select(["query", "x"]).append_column("far", pa.array(far))

    return run


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({
                "query": pa.array([], pa.int64()), "point": pa.array([], pa.int64()),
                "dist": pa.array([], pa.float64()), "n": pa.array([], pa.int64()),
            })
        found, dist, n = _candidates(left, right, k)
        keep = (n > 0) & ~(dist > left.column("far").to_numpy()[:, None])
        names = np.repeat(left.column("query").to_numpy(), keep.sum(axis=1))
        return pa.table({"query": names, "point": found[keep], "dist": dist[keep], "n": n[keep]})

    return run


def nearest_rows(queries: DataFrame, points: DataFrame, k: int, block_rows: int = 2_000) -> DataFrame:
    """The exact k nearest points of every query, as rows (query, point, dist, n, upto).

    ``queries`` has ``query`` (long) and ``x`` (array), ``points`` has ``point``, ``x`` and, if
    its rows stand for several equal ones, ``weight`` (long). ``n`` says how many copies of the
    point are among the k, ``upto`` how many there are up to and with them. A query leaves out one
    copy of the point with its own number. Ties go to the smaller point. Without points there are no rows.

    A query looks in its own cell, or in the nearest one that holds k others; the k-th distance there
    tells which cells can hold a nearer point, and which points of a cell are sent back. The work follows
    the rows of ``points``, not their weights.
    """
    spark = points.sparkSession
    weight = F.col("weight").cast("long") if "weight" in points.columns else F.lit(1).cast("long")
    rows = points.select("point", "x", weight.alias("weight"))
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "query long, point long, dist double, n long, upto long")
    share = min(1.0, _SAMPLE / total)
    drawn = rows.filter(F.pmod(F.xxhash64("point", F.lit("tree")), F.lit(1_000_000)) < F.lit(round(share * 1_000_000)))
    x = _vectors(drawn.select("x").toArrow())
    # Some sampled rows per leaf at least, so that the number of cells is bounded.
    tree = _Tree.grow(x, max(share * block_rows, 8.0 if share < 1 else 1.0))
    placed = materialize(rows.mapInArrow(_place(tree), "point long, x array<double>, weight long, cell int"), "points")
    width = len(placed.select("x").first()["x"])
    # One row per cell.
    sums = placed.groupBy("cell").agg(
        F.sum("weight").alias("rows"), F.ceil(F.count("*") / (2 * block_rows)).cast("int").alias("parts"),
        F.array(*[F.min(F.col("x")[i]) for i in range(width)]).alias("low"),
        F.array(*[F.max(F.col("x")[i]) for i in range(width)]).alias("high"),
    ).orderBy("cell").collect()
    cells = _Cells(*[np.array([r[i] for r in sums]) for i in range(3)], *[np.array([r[i] for r in sums], float) for i in (3, 4)])
    # A cell may hold many points: they are dealt to parts of a bounded size.
    dealt = spark.createDataFrame([(r["cell"], r["parts"]) for r in sums if r["parts"] > 1], "cell int, parts int")
    parts = F.coalesce("parts", F.lit(1))
    held = placed.join(F.broadcast(dealt), "cell", "left").select(
        "cell", F.pmod(F.xxhash64("point"), parts).cast("int").alias("part"), "point", "x", "weight"
    )

    def ask(visits: DataFrame, answer, schema: str) -> DataFrame:
        keys = ("cell", "part")
        return by_group(visits, *keys).groupBy(*keys).cogroup(by_group(held, *keys).groupBy(*keys)).applyInArrow(answer, schema)

    asked, vector = queries.select("query", "x"), "query long, x array<double>"
    if (cells.rows > k * cells.parts).any():
        at_home = asked.mapInArrow(_go_home(tree, cells, k), f"{vector}, cell int, part int")
        limits = materialize(ask(at_home, _reach(k), f"{vector}, far double"), "reach")
    else:
        limits = asked.withColumn("far", F.lit(float("inf")))
    visits = limits.mapInArrow(_go_near(cells), f"{vector}, far double, cell int, part int")
    found = ask(visits, _search(k), "query long, point long, dist double, n long")
    best = Window.partitionBy("query").orderBy("dist", "point").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(best), F.lit(0))
    kept = found.withColumn("before", before).withColumn("n", F.least(F.col("n"), k - F.col("before"))).filter("n > 0")
    return kept.select("query", "point", "dist", "n", (F.col("before") + F.col("n")).alias("upto"))
