"""Line dedup through a sharded minimal perfect hash over all distinct line hashes.

Spark counts the distinct line hashes and deals them to shards. Each shard is a minimal
perfect hash (levels of bit arrays; a key sits where it is alone, others go one level down)
that indexes three arrays: a fingerprint, the number of documents, and the largest doc_id.
Documents send the hashes of their lines to the shards and look them up there.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftguard.llm.words import mix
from siftguard.session import materialize, spread

BLANK = b" \t\n\x0b\x0c\r"
_LEVEL = np.uint64(0x9E3779B97F4A7C15)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys with their values."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, prints: np.ndarray, counts: np.ndarray, largest: np.ndarray):
        self.sizes, self.bits, self.prints, self.counts, self.largest = sizes, bits, prints, counts, largest
        self.ranks = np.cumsum(bits) - 1
        self.offsets = np.cumsum(sizes) - sizes

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys ^ (_LEVEL * np.array([level + 1], np.uint64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, prints: np.ndarray, counts: np.ndarray, largest: np.ndarray) -> PerfectHash:
        sizes, bits, rest = [], [], keys
        while len(rest):
            size = 2 * len(rest) + 1
            places = cls._places(rest, len(sizes), size)
            alone = np.bincount(places, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            rest = rest[~alone[places]]
        empty = cls(np.array(sizes, np.int64), np.concatenate(bits), prints, counts, largest)
        at = empty.index(keys)
        order = np.empty(len(at), np.int64)
        order[at] = np.arange(len(at))
        return cls(empty.sizes, empty.bits, prints[order], np.minimum(counts[order], 65_535).astype(np.uint16), largest[order])

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Place of every key, -1 if it is certainly none of the set's."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (offset, size) in enumerate(zip(self.offsets.tolist(), self.sizes.tolist())):
            places = offset + self._places(keys[open_], level, size)
            hit = self.bits[places]
            out[open_[hit]] = self.ranks[places[hit]]
            open_ = open_[~hit]
        return out

    def look_up(self, keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of documents and largest id of every key; 0 and -1 for foreign keys."""
        at = self.index(keys)
        known = at >= 0
        known[known] = self.prints[at[known]] == prints[known]
        counts, largest = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        counts[known], largest[known] = self.counts[at[known]], self.largest[at[known]]
        return counts, largest

    def to_bytes(self) -> bytes:
        head = np.array([len(self.prints), len(self.sizes), *self.sizes], np.int64)
        return b"".join(x.tobytes() for x in (head, self.largest, self.prints, self.counts, np.packbits(self.bits)))

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        n, levels = np.frombuffer(raw, np.int64, 2).tolist()
        sizes = np.frombuffer(raw, np.int64, levels, 16)
        at = 16 + 8 * levels
        largest = np.frombuffer(raw, np.int64, n, at)
        prints = np.frombuffer(raw, np.uint32, n, at + 8 * n)
        counts = np.frombuffer(raw, np.uint16, n, at + 12 * n)
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, offset=at + 14 * n), count=int(sizes.sum())).astype(bool)
        return cls(sizes, bits, prints, counts, largest)


def _key(line: bytes, least: int) -> bytes | None:
    """Key of a line, None if it has fewer code points than asked for."""
    key = line.strip(BLANK).lower()
    if len(key) < least or (not key.isascii() and len(key.decode()) < least):
        return None
    return key


def _line_keys(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, prints, bounds = [], [], [0]
            for text in batch.column(1):
                lines = (text.as_py() or "").encode().split(b"\n")
                for digest in {xxhash.xxh3_128_digest(k) for k in map(_key, lines, [least] * len(lines)) if k is not None}:
                    hashes.append(digest[:8])
                    prints.append(digest[8:12])
                bounds.append(len(hashes))
            bounds = pa.array(bounds, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.ListArray.from_arrays(bounds, pa.array(np.frombuffer(b"".join(hashes), np.int64))),
                pa.ListArray.from_arrays(bounds, pa.array(np.frombuffer(b"".join(prints), np.int32))),
            ], ["doc_id", "hashes", "prints"])

    return run


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One perfect hash per shard; a shard's rows come together."""
    held: list[pa.RecordBatch] = []
    shard = None

    def finish() -> pa.RecordBatch:
        keys, prints, counts, largest = (
            np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (1, 2, 3, 4)
        )
        made = PerfectHash.build(keys.view(np.uint64), prints.view(np.uint32), counts, largest)
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.array([made.to_bytes()])],
            ["shard", "load", "index"],
        )

    for batch in batches:
        shards = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                if shards[a] != shard and held:
                    yield finish()
                    held = []
                shard = int(shards[a])
                held.append(batch.slice(a, b - a))
    if held:
        yield finish()


def _probe(documents: int):
    """Look up line hashes; a shard's index comes before its hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            kinds = batch.column(2).to_numpy()
            cuts = np.flatnonzero(kinds == 0).tolist()
            parts = [(0, cuts[0] if cuts else len(kinds), False)]
            parts += [(a, b, True) for a, b in zip(cuts, [*cuts[1:], len(kinds)])]
            for a, b, fresh in parts:
                if fresh:
                    index = PerfectHash.from_bytes(batch.column(6)[a].as_py())
                    a += 1
                if b <= a:
                    continue
                ids = batch.column(3).slice(a, b - a).to_numpy()
                keys = batch.column(4).slice(a, b - a).to_numpy()
                prints = batch.column(5).slice(a, b - a).to_numpy().view(np.uint32)
                counts, largest = index.look_up(keys.view(np.uint64), prints)
                drop = (counts >= documents) & (ids < largest)
                yield pa.RecordBatch.from_arrays([pa.array(ids[drop]), pa.array(keys[drop])], ["doc_id", "hash"])

    return run


def _drop(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, digests, kept = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                raw = (text.as_py() or "").encode()
                lines = raw.split(b"\n")
                n_lines.append(len(lines))
                gone = set(batch.column(2)[i].as_py() or ())
                if gone:
                    left = []
                    for line in lines:
                        key = _key(line, least)
                        if key is None or int.from_bytes(xxhash.xxh3_128_digest(key)[:8], "little", signed=True) not in gone:
                            left.append(line)
                    n_dropped.append(len(lines) - len(left))
                    raw = b"\n".join(left)
                    kept.append(raw.decode())
                else:
                    n_dropped.append(0)
                    kept.append(None)
                digests.append(sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                pa.array(digests, pa.string()), pa.array(kept, pa.string()),
            ], ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept"])

    return run


def drop_common_lines(docs: DataFrame, documents: int = 3, least: int = 20, shard_keys: int = 200_000) -> DataFrame:
    """Drop lines that many documents have, but in the document with the largest id.

    Lines are split at line feeds; a null or empty text is one empty line. A line's key is
    the line without ASCII white space at both ends, A-Z lower-cased. Keys of at least
    ``least`` code points found in at least ``documents`` documents (at most 65,535) lose all
    their lines except in the largest doc_id that has them. Returns, per input row, doc_id,
    n_lines, n_dropped, kept_sha256 of the kept lines joined by line feeds, and kept (their
    text, null where nothing goes). Each row is a document; rows that repeat a doc_id must
    repeat its text; rows without a doc_id lose nothing and do not count. Other columns are
    ignored. Two keys are held to be equal if their 64-bit hashes are.
    """
    docs = spread(docs.select("doc_id", "text"))
    known = docs.filter("doc_id is not null")
    keys = materialize(
        known.mapInArrow(_line_keys(least), "doc_id long, hashes array<long>, prints array<int>"), "line-keys"
    )
    total = keys.agg(F.sum(F.size("hashes"))).first()[0] or 0
    shards = max(1, -(-total // shard_keys))
    rows = keys.select("doc_id", F.explode(F.arrays_zip("hashes", "prints")).alias("k")).select(
        F.pmod(F.col("k.hashes"), F.lit(shards)).alias("shard"), "doc_id", F.col("k.hashes").alias("hash"), F.col("k.prints").alias("print")
    )
    # Once per document: by document first, so that a frequent line is spread before it is counted.
    once = rows.groupBy("shard", "hash", "doc_id").agg(F.min("print").alias("print"))
    counted = once.groupBy("shard", "hash").agg(
        F.min("print").alias("print"), F.count("*").alias("n"), F.max("doc_id").alias("largest")
    )
    index = materialize(
        counted.repartition("shard").sortWithinPartitions("shard").select("shard", "hash", "print", "n", "largest")
        .mapInArrow(_build, "shard long, load long, index binary"), "line-index"
    )
    # A shard with frequent lines is looked up in several tasks, each with a copy of its index.
    salts = index.select("shard", F.ceil(F.col("load") / (4 * shard_keys)).cast("int").alias("salts")).filter("salts > 1")
    salted = rows.join(salts, "shard", "left").select(
        "shard", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"),
        F.lit(1).alias("kind"), "doc_id", "hash", "print", F.lit(None).cast("binary").alias("index"),
    )
    copies = index.select(
        "shard", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("load") / (4 * shard_keys)), F.lit(1)).cast("int") - 1)).alias("salt"),
        F.lit(0).alias("kind"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("hash"),
        F.lit(0).alias("print"), "index",
    )
    gone = (
        salted.union(copies).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
        .mapInArrow(_probe(documents), "doc_id long, hash long")
    )
    per_doc = materialize(gone.groupBy("doc_id").agg(F.collect_set("hash").alias("gone")), "lines-to-drop")
    # The same plan at every size: the texts are shuffled once.
    return docs.join(per_doc.hint("merge"), "doc_id", "left").select("doc_id", "text", "gone").mapInArrow(
        _drop(least), "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept string"
    )
