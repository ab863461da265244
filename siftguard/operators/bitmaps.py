"""Bitmap index of a feature table, for counting very many rule sets.

The table is cut into blocks of rows once. A block keeps, per feature, the values that are not zero
in sorted order with the rows they stand in, and the rows without a value; mostly empty
columns are small. A condition (feature, op, threshold) is a span of that order, hence one bitmap per
block; equal spans are one bitmap. Rules are ANDs, rule sets ORs, and counts popcounts.
Spark runs the blocks side by side and adds their counters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftguard.operators.columns import sketch
from siftguard.session import materialize, spread

BLOCK_ROWS = 16_384
BLOCKS = (
    "n int, label array<byte>, rows array<int>, vals array<double>, bounds array<int>, missing array<int>, missing_bounds array<int>"
)
COUNTS = "set_id int, tp long, fp long, positives long"


def _lists(flat: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat, kind))


def _block(label: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    rows, vals, missing = [], [], []
    for x in columns:
        some = np.flatnonzero((x != 0) & ~np.isnan(x))
        order = some[np.argsort(x[some], kind="stable")]
        rows.append(order)
        vals.append(x[order])
        missing.append(np.flatnonzero(np.isnan(x)))
    ends = lambda parts: np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.RecordBatch.from_arrays([
        pa.array([len(label)], pa.int32()), _lists(label, pa.int8()), _lists(np.concatenate(rows), pa.int32()),
        _lists(np.concatenate(vals), pa.float64()), _lists(ends(rows), pa.int32()),
        _lists(np.concatenate(missing), pa.int32()), _lists(ends(missing), pa.int32()),
    ], ["n", "label", "rows", "vals", "bounds", "missing", "missing_bounds"])


def _cut(block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, block_rows):
                part = batch.slice(start, block_rows)
                columns = [c.fill_null(float("nan")).to_numpy(zero_copy_only=False) for c in part.columns[1:]]
                yield _block(part.column(0).to_numpy(), columns)

    return run


@dataclass
class BitmapIndex:
    """Blocks of a table and the names of the features, in the order of their numbers."""

    blocks: DataFrame
    features: list[str]
    number: dict[str, int] = field(init=False)

    def __post_init__(self):
        self.number = {f: i for i, f in enumerate(self.features)}


def build_index(df: DataFrame, label: str, features: list[str], block_rows: int = BLOCK_ROWS) -> BitmapIndex:
    """Index of a table by one narrow pass, written to the shared folder and kept in the cache.

    Rows without a label are left out. NULL and NaN are missing and meet no condition.
    """
    rows = df.filter(F.col(label).isNotNull()).select(
        (F.col(label) == 1).cast("byte").alias("y"), *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)]
    )
    blocks = materialize(spread(rows).mapInArrow(_cut(block_rows), BLOCKS), "bitmap-index")
    return BitmapIndex(blocks.persist(StorageLevel.MEMORY_AND_DISK), list(features))


@dataclass
class Ask:
    """Rule sets to count, as arrays over (set, rule, condition); feature -1 is no condition.

    Rules have conditions; a set without rules never fires. Counted are rows in which the rule
    ``within`` fires and, of the positives, those that no rule of ``beyond`` covers.
    """

    feature: np.ndarray
    op: np.ndarray
    thr: np.ndarray
    within: list = field(default_factory=list)
    beyond: list = field(default_factory=list)


def encode(index: BitmapIndex, sets: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rule sets as arrays. Rules must have conditions."""
    shape = (len(sets), max([1, *map(len, sets)]), max([1, *(len(r) for s in sets for r in s)]))
    feature, op, thr = np.full(shape, -1), np.ones(shape, int), np.zeros(shape)
    for i, rules in enumerate(sets):
        for j, rule in enumerate(rules):
            for k, (f, o, t) in enumerate(rule):
                feature[i, j, k], op[i, j, k], thr[i, j, k] = index.number[f], o, t
    return feature, op, thr


class _Conditions:
    """Numbers for the distinct conditions of many rule sets; 0 holds always, 1 never."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.size = 2

    def add(self, feature: np.ndarray, op: np.ndarray, thr: np.ndarray) -> np.ndarray:
        """Index (set, rule, condition) into the distinct conditions."""
        real = feature >= 0
        table = np.stack([feature[real].astype(float), op[real].astype(float), thr[real]], axis=1)
        distinct, back = np.unique(table, axis=0, return_inverse=True)
        out = np.zeros(feature.shape, np.int32)
        out[real] = back.reshape(-1) + self.size
        out[~real.any(axis=-1)] = 1
        self.parts.append(distinct)
        self.size += len(distinct)
        return out

    def table(self) -> np.ndarray:
        return np.concatenate(self.parts) if self.parts else np.zeros((0, 3))


def _words(mask: np.ndarray) -> np.ndarray:
    bits = np.packbits(mask)
    return np.pad(bits, (0, -len(bits) % 8)).view(np.uint64)


class _Bitmaps:
    """Bitmaps of one block."""

    def __init__(self, n: int, label, rows, vals, bounds, missing, missing_bounds):
        self.n, self.rows, self.vals, self.bounds = n, rows, vals, bounds
        self.missing, self.missing_bounds = missing, missing_bounds
        self.positive = _words(label == 1)
        self.all = _words(np.ones(n, bool))

    def conditions(self, table: np.ndarray) -> np.ndarray:
        """Bitmap per condition (feature, op, threshold), after those that hold always and never."""
        out = np.zeros((len(table) + 2, len(self.all)), np.uint64)
        out[0] = self.all
        known: dict[tuple, int] = {}
        features, ops = table[:, 0].astype(int), table[:, 1] > 0
        for i, (f, above, t) in enumerate(zip(features.tolist(), ops.tolist(), table[:, 2].tolist()), 2):
            a, b = self.bounds[f], self.bounds[f + 1]
            vals = self.vals[a:b]
            k = int(np.searchsorted(vals, t, "right" if above else "left"))
            zeros = t < 0 if above else t > 0
            key = (f, above, k, zeros)
            if key in known:
                out[i] = out[known[key]]
                continue
            known[key] = i
            met, rest = (self.rows[a + k: b], self.rows[a: a + k]) if above else (self.rows[a: a + k], self.rows[a + k: b])
            mask = np.full(self.n, zeros)
            if zeros:
                mask[rest] = False
                mask[self.missing[self.missing_bounds[f]: self.missing_bounds[f + 1]]] = False
            else:
                mask[met] = True
            out[i] = _words(mask)
        return out


def _fired(bitmaps: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """Bitmap of each set: OR over rules of the AND over conditions."""
    out = np.zeros((len(rules), bitmaps.shape[1]), np.uint64)
    for j in range(rules.shape[1]):
        rule = bitmaps[rules[:, j, 0]]
        for k in range(1, rules.shape[2]):
            rule &= bitmaps[rules[:, j, k]]
        out |= rule
    return out


def _counter(table: np.ndarray, asks: list[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((3, sum(len(a[0]) for a in asks)), np.int64)
        count = lambda bits: np.bitwise_count(bits).sum(axis=-1, dtype=np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                lists = [batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in range(1, 7)]
                block = _Bitmaps(batch.column(0)[i].as_py(), *lists)
                bitmaps = block.conditions(table)
                at = 0
                for rules, within, beyond in asks:
                    counted = _fired(bitmaps, within)[0] if within is not None else block.all
                    positive = block.positive & counted
                    negative = counted & ~block.positive
                    if beyond is not None:
                        positive = positive & ~_fired(bitmaps, beyond)[0]
                    open_ = count(positive)
                    # Some hundred sets at a time bound the memory.
                    for start in range(0, len(rules), 256):
                        fired = _fired(bitmaps, rules[start: start + 256])
                        span = slice(at, at + len(fired))
                        totals[0, span] += count(fired & positive)
                        totals[1, span] += count(fired & negative)
                        totals[2, span] += open_
                        at += len(fired)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(totals.shape[1], dtype=np.int32)), *[pa.array(t) for t in totals]],
            ["set_id", "tp", "fp", "positives"],
        )

    return run


# kind 0: sum (v) and missing values (c) of a feature among negatives; 1: a value of an open positive;
# 2: missing values of open positives; 3: open positives (c) and negatives (v) of a block.
PARTS = "f int, kind int, v double, c long"


def _parts(table: np.ndarray, covered: np.ndarray | None, every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lists = [batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in range(1, 7)]
                block = _Bitmaps(batch.column(0)[i].as_py(), *lists)
                open_ = block.positive
                if covered is not None:
                    open_ = open_ & ~_fired(block.conditions(table), covered)[0]
                wanted = np.unpackbits(open_.view(np.uint8))[: block.n].astype(bool)
                negative = lists[0] != 1
                of = np.repeat(np.arange(len(block.bounds) - 1), np.diff(block.bounds))
                some = wanted[block.rows]
                out = [(of[some], np.ones(some.sum(), int), block.vals[some], np.ones(some.sum(), int))]
                if every:
                    width = len(block.bounds) - 1
                    of_missing = np.repeat(np.arange(width), np.diff(block.missing_bounds))
                    counts = lambda mask: np.bincount(of_missing[mask[block.missing]], minlength=width)
                    rest = negative[block.rows]
                    sums = np.bincount(of[rest], weights=block.vals[rest], minlength=width)
                    out.append((np.arange(width), np.zeros(width, int), sums, counts(negative)))
                    out.append((np.arange(width), np.full(width, 2), np.zeros(width), counts(wanted)))
                    out.append(([-1], [3], [float(negative.sum())], [int(wanted.sum())]))
                f, kind, v, c = (np.concatenate([np.asarray(o[k]) for o in out]) for k in range(4))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f, pa.int32()), pa.array(kind, pa.int32()), pa.array(v, pa.float64()), pa.array(c, pa.int64())],
                    ["f", "kind", "v", "c"],
                )

    return run


def _index_parts(index: BitmapIndex, covered: list, every: bool) -> DataFrame:
    conditions = _Conditions()
    rules = conditions.add(*encode(index, [covered])) if covered else None
    return index.blocks.mapInArrow(_parts(conditions.table(), rules, every), PARTS)


def open_pairs(index: BitmapIndex, covered: list) -> DataFrame:
    """f and v of the values, zeros left out, of positives that no rule covers."""
    return _index_parts(index, covered, False).select("f", "v")


def class_parts(index: BitmapIndex, covered: list) -> tuple[dict, int, int]:
    """Sums by feature over open positives and negatives, with a sketch of the former; how many there are of both."""
    kind, v, c = F.col("kind"), F.col("v"), F.col("c")
    one = kind == 1
    rows = _index_parts(index, covered, True).groupBy("f").agg(
        F.sum(F.when(one, v)).alias("s1"), F.sum(F.when(kind == 0, v)).alias("s0"), F.count_if(one).alias("pairs"),
        F.sum(F.when(kind == 2, c)).alias("no1"), F.sum(F.when(kind == 0, c)).alias("no0"),
        F.count_if(one & (v < 0)).alias("below"), sketch(F.when(one, v)).alias("grid"),
        F.sum(F.when(kind == 3, c)).alias("n_open"), F.sum(F.when(kind == 3, v)).alias("n_neg"),
    ).collect()
    of = {r["f"]: r for r in rows}
    whole = of.pop(-1, None)
    return of, (whole["n_open"] if whole else 0), (int(whole["n_neg"]) if whole else 0)


def count_rule_sets(index: BitmapIndex, asks: list[Ask]) -> list[np.ndarray]:
    """True positives, false positives and counted positives of every set of every ask, in one job.

    The driver gets three numbers per set, whatever the rows.
    """
    conditions, coded = _Conditions(), []
    for a in asks:
        rules = conditions.add(a.feature, a.op, a.thr)
        within = conditions.add(*encode(index, [[a.within]])) if a.within else None
        beyond = conditions.add(*encode(index, [a.beyond])) if a.beyond else None
        coded.append((rules, within, beyond))
    parts = index.blocks.mapInArrow(_counter(conditions.table(), coded), COUNTS)
    rows = parts.groupBy("set_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "positives")]).collect()
    out = np.zeros((3, sum(len(a.feature) for a in asks)), np.int64)
    for r in rows:
        out[:, r[0]] = r[1:]
    return np.split(out, np.cumsum([len(a.feature) for a in asks])[:-1], axis=1)
