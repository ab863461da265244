"""Benchmark decontamination: Wu-Manber search for all windows of the benchmark's items.

The alphabet is words. For the windows of one length a shift table, indexed by the hash of a
block of two words, tells how far the search may move on from a block; most positions of a
text are never looked at. Where the shift is zero the block's full hash selects the bucket of
windows that end with it, and those are compared word by word, then by their text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftguard.llm.words import NOT_ALNUM, covered, mix, pieces
from siftguard.session import materialize, spread

LANE = 256
_STEP = np.uint64(0xD6E8FEB86659FD93)


class WuManber:
    """Search for word sequences of one length."""

    def __init__(self, codes: np.ndarray, table_bits: int = 18):
        """``codes`` has a row of word hashes per window."""
        self.length = codes.shape[1]
        self.block = min(2, self.length)
        self.bits = np.uint64(64 - table_bits)
        self.shifts = np.full(1 << table_bits, self.length - self.block + 1, np.int32)
        for j in range(self.length - self.block + 1):
            np.minimum.at(self.shifts, self._cell(self._blocks(codes[:, j: j + self.block])), self.length - self.block - j)
        suffixes = self._blocks(codes[:, self.length - self.block:])
        self.order = np.argsort(suffixes, kind="stable")
        self.suffixes, self.codes = suffixes[self.order], codes[self.order]

    @staticmethod
    def _blocks(rows: np.ndarray) -> np.ndarray:
        out = mix(rows[:, 0] + np.uint64(1))
        for j in range(1, rows.shape[1]):
            out = mix(out * _STEP + rows[:, j])
        return out

    def _cell(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks >> self.bits).astype(np.int64)

    def search(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of every occurrence, and the row of its window."""
        m, n = self.length, len(words)
        if n < m or not len(self.codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # Block that ends at word i stands at i - block + 1.
        ends = np.stack([words[j: n - self.block + 1 + j] for j in range(self.block)], axis=1)
        blocks = self._blocks(ends)
        shift = self.shifts[self._cell(blocks)]
        # Lanes of the text move on side by side, each by its own shifts.
        at = np.arange(m - self.block, len(blocks), LANE)
        stop = np.minimum(at + LANE, len(blocks))
        stops = []
        while len(at):
            step = shift[at]
            stops.append(at[step == 0])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        at = np.sort(np.concatenate(stops))
        low = np.searchsorted(self.suffixes, blocks[at], "left")
        high = np.searchsorted(self.suffixes, blocks[at], "right")
        starts, rows = [], []
        begin = at - (m - self.block)
        while len(begin):
            live = low < high
            begin, low, high = begin[live], low[live], high[live]
            same = np.ones(len(begin), bool)
            for j in range(m):
                same &= words[begin + j] == self.codes[low, j]
            starts.append(begin[same])
            rows.append(self.order[low[same]])
            low = low + 1
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(starts), np.concatenate(rows)


class Windows:
    """All windows of some benchmark items, by length."""

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        texts: dict[int, dict[bytes, int]] = defaultdict(dict)
        codes: dict[int, list[np.ndarray]] = defaultdict(list)
        owners: dict[int, list[set[str]]] = defaultdict(list)
        names = [name for name, _ in items]
        for piece in pieces(pa.array([text for _, text in items], pa.string()), NOT_ALNUM, lower=True):
            words, data = piece.hashes(), piece.data.tobytes()
            spans = list(zip(piece.starts.tolist(), piece.ends.tolist()))
            for i, row in enumerate(piece.rows):
                a, b = int(piece.first[i]), int(piece.first[i + 1])
                m = min(width, b - a)
                for s in range(a, b - m + 1) if m else ():
                    text = b" ".join(data[x:y] for x, y in spans[s: s + m])
                    k = texts[m].setdefault(text, len(texts[m]))
                    if k == len(codes[m]):
                        codes[m].append(words[s: s + m])
                        owners[m].append(set())
                    owners[m][k].add(names[row])
        self.tables = {m: WuManber(np.stack(rows)) for m, rows in codes.items()}
        self.texts = {m: list(found) for m, found in texts.items()}
        self.owners = {m: [sorted(o) for o in found] for m, found in owners.items()}

    def find(self, piece) -> Iterator[tuple[int, int, int, list[str]]]:
        """(document of the piece, first word, words, items) of every occurrence."""
        words, docs, data = piece.hashes(), piece.docs(), None
        for m, table in self.tables.items():
            starts, rows = table.search(words)
            inside = docs[starts] == docs[starts + m - 1] if len(starts) else np.zeros(0, bool)
            data = piece.data.tobytes() if data is None and inside.any() else data
            for s, k in zip(starts[inside].tolist(), rows[inside].tolist()):
                text = b" ".join(data[x:y] for x, y in zip(piece.starts[s: s + m].tolist(), piece.ends[s: s + m].tolist()))
                if text == self.texts[m][k]:
                    yield int(docs[s]), s, m, self.owners[m][k]


HITS = "hits array<struct<begin: int, words: int>>, items array<string>"


def _scan(shared, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            for piece in pieces(batch.column(1), NOT_ALNUM, lower=True):
                part = batch.slice(piece.rows.start, len(piece.rows))
                hits = [{(h["begin"], h["words"]) for h in x or ()} for x in part.column(2).to_pylist()]
                items = [set(x or ()) for x in part.column(3).to_pylist()]
                for i, s, m, owners in windows.find(piece):
                    hits[i].add((s - int(piece.first[i]), m))
                    items[i].update(owners)
                if not last:
                    yield pa.RecordBatch.from_arrays([
                        part.column(0), part.column(1),
                        pa.array([[{"begin": b, "words": w} for b, w in sorted(h)] for h in hits],
                                 pa.list_(pa.struct([("begin", pa.int32()), ("words", pa.int32())]))),
                        pa.array([sorted(x) for x in items], pa.list_(pa.string())), *part.columns[4:],
                    ], ["doc_id", "text", "hits", "items", *part.schema.names[4:]])
                    continue
                n_words = np.diff(piece.first)
                n_hit = []
                for n, found in zip(n_words.tolist(), hits):
                    hit = np.zeros(n, bool)
                    for m in {m for _, m in found}:
                        hit |= covered(n, np.array([b for b, w in found if w == m]), m)
                    n_hit.append(int(hit.sum()))
                names = [",".join(sorted(x)) for x in items]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                    pa.array([len(x) for x in items], pa.int64()),
                    pa.array([sha256(x.encode()).hexdigest() for x in names], pa.string()),
                    pa.array([x > 0 for x in n_hit], pa.bool_()),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())), *part.columns[4:],
                ], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", *part.schema.names[4:]])

    return run


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = 16_000_000, key: tuple[str, ...] = ()
) -> DataFrame:
    """Which words of each document lie in windows of benchmark items.

    Words are runs of ASCII letters, digits and all characters beyond ASCII, A-Z
    lower-cased. A window is ``width`` consecutive words of an item; a shorter item is one
    window; an item without words has none. Returns, per input row, doc_id, n_words, n_hit
    (words inside any occurrence), n_items and items (those with an occurrence, as sorted
    strings), items_sha256 (of their comma-joined ids) and contaminated (n_hit > 0). Null and
    empty texts have no words. Repeated rows and ids are independent rows; repeated items
    count by id; an item without an id counts under the empty string. Other columns are
    ignored. The benchmark goes to the tasks in blocks of about ``block_bytes`` of text,
    one after the other, so any size of it is searched. Long columns named in ``key`` are
    returned as well.
    """
    carried = "".join(f", `{k}` long" for k in key)
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    scanned = spread(docs.select("doc_id", "text", *key)).select(
        "*", F.expr("CAST(NULL AS array<struct<begin: int, words: int>>)").alias("hits"),
        F.expr("CAST(NULL AS array<string>)").alias("items"),
    ).select("doc_id", "text", "hits", "items", *key)
    for i in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).collect()
        shared = spark.sparkContext.broadcast(Windows([tuple(r) for r in block], width))
        if i < blocks - 1:
            scanned = materialize(scanned.mapInArrow(_scan(shared, False), "doc_id long, text string, " + HITS + carried), "hits")
    return scanned.mapInArrow(
        _scan(shared, True),
        "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>" + carried,
    )
