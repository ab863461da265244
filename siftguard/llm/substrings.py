"""Substring dedup: windows of words that a document with a smaller id also has are removed.

Every window of ``width`` words gets a Rabin-Karp hash, and so does every half of a window.
A window is represented by the least of the hashes of its halves, its anchor; neighbouring
windows mostly have the same one, which makes runs of windows. Equal windows have equal
anchors, so only anchors that Spark counts in at least two documents matter. If all
documents with an anchor have it in equal runs, the smallest doc_id decides for the whole run.
Otherwise (at the edges of repeated passages) the windows themselves are counted. Overlapping
repeated windows merge into maximal intervals, which are cut out.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftguard.llm.words import SPACES, Piece, covered, lists, pieces, sliding_min, span_hashes, window_sums
from siftguard.session import materialize, spread

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _anchors(piece: Piece, codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor of the window at each word, and whether the window stays in its document."""
    half = (width + 1) // 2
    least = sliding_min(window_sums(codes, half), width - half + 1)
    docs = piece.docs()
    return least, docs[: len(least)] == docs[len(docs) - len(least):]


def _runs(piece: Piece, codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, anchor and content hash of every run of windows with one anchor."""
    least, inside = _anchors(piece, codes, width)
    at = np.flatnonzero(inside)
    if not len(at):
        return at, least[:0], least[:0]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (np.diff(at) > 1) | (least[at[1:]] != least[at[:-1]])
    heads = np.flatnonzero(fresh)
    begin, last = at[heads], at[np.append(heads[1:], len(at)) - 1]
    return begin, least[begin], span_hashes(codes, begin, last + width)


def _whole(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1)):
                begin, anchors, contents = _runs(piece, piece.hashes(), width)
                bounds = np.searchsorted(begin, piece.first)
                cuts = piece.offsets.tolist()
                digests = [
                    sha256(b" ".join(piece.data[a:b].tobytes().split())).hexdigest() for a, b in zip(cuts, cuts[1:])
                ]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(piece.rows.start, len(piece.rows)),
                    pa.array(np.diff(piece.first), pa.int64()), pa.array(digests, pa.string()),
                    lists(anchors, bounds), lists(contents, bounds),
                ], ["doc_id", "n_words", "kept_sha256", "anchors", "contents"])

    return run


def _members(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    at = np.searchsorted(wanted, values)
    at[at == len(wanted)] = 0
    return wanted[at] == values


def _hashes_of(batch: pa.RecordBatch, column: int, row: int) -> np.ndarray:
    cell = batch.column(column)[row]
    if not cell.is_valid:
        return np.zeros(0, np.uint64)
    return np.sort(cell.values.to_numpy(zero_copy_only=False).view(np.uint64))


def _undecided(width: int):
    """Windows whose anchor stands in different runs: (anchor, window) once per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1)):
                codes = piece.hashes()
                least, inside = _anchors(piece, codes, width)
                windows = window_sums(codes, width)
                for i, row in enumerate(piece.rows):
                    part = slice(piece.first[i], max(piece.first[i], min(piece.first[i + 1], len(least))))
                    keep = inside[part] & _members(least[part], _hashes_of(batch, 2, row))
                    pairs = np.unique(np.stack([least[part][keep], windows[part][keep]]), axis=1)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(pairs.shape[1], batch.column(0)[row].as_py(), np.int64)),
                        pa.array(pairs[0].view(np.int64)), pa.array(pairs[1].view(np.int64)),
                    ], ["doc_id", "anchor", "window"])

    return run


def _cut(width: int):
    """Remove the words of windows named by their anchor or by their own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1)):
                codes = piece.hashes()
                least, inside = _anchors(piece, codes, width)
                windows = window_sums(codes, width)
                out = []
                for i, row in enumerate(piece.rows):
                    a, b = int(piece.first[i]), int(piece.first[i + 1])
                    part = slice(a, max(a, min(b, len(least))))
                    hit = _members(least[part], _hashes_of(batch, 2, row))
                    hit |= _members(windows[part], _hashes_of(batch, 3, row))
                    gone = covered(b - a, np.flatnonzero(hit & inside[part]), width)
                    spans = zip(piece.starts[a:b][~gone].tolist(), piece.ends[a:b][~gone].tolist())
                    text = piece.data.tobytes() if i == 0 else text
                    kept = b" ".join([text[s:e] for s, e in spans])
                    out.append((batch.column(0)[row].as_py(), b - a, int(gone.sum()), sha256(kept).hexdigest(), kept.decode()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[j] for r in out], t) for j, t in enumerate(
                        [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()])],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    return run


def remove_repeats(docs: DataFrame, width: int = 50) -> tuple[DataFrame, DataFrame]:
    """Digest of every document, and the texts of those that change.

    Words are runs of characters other than ASCII white space; a window is ``width``
    consecutive words of one document. A word goes if a window over it also starts in a
    document with a smaller doc_id. The first table has doc_id, n_words, n_removed and
    kept_sha256 of the kept words joined by one space, one row per input row; the second has
    doc_id and kept for the documents that lose words. Null and empty texts have no words.
    Rows without a doc_id lose nothing and take nothing from others; rows that repeat a
    doc_id must repeat its text and give equal rows. Other columns are ignored.
    """
    docs = spread(docs.select("doc_id", "text"))
    whole = materialize(docs.mapInArrow(
        _whole(width), "doc_id long, n_words long, kept_sha256 string, anchors array<long>, contents array<long>"
    ), "windows")
    base = whole.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    rows = whole.filter("doc_id is not null and size(anchors) > 0").select(
        "doc_id", F.explode(F.arrays_zip("anchors", "contents")).alias("r")
    ).select("doc_id", F.col("r.anchors").alias("anchor"), F.col("r.contents").alias("content"))
    counted = rows.groupBy("anchor").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
        (F.min("content") == F.max("content")).alias("same"),
    ).filter("low < high").select("anchor", "low", "same")
    found = rows.select("doc_id", "anchor").join(counted, "anchor").filter("doc_id > low or not same")
    per_doc = materialize(found.groupBy("doc_id").agg(
        F.collect_set(F.when(F.col("same"), F.col("anchor"))).alias("gone"),
        F.collect_set(F.when(~F.col("same"), F.col("anchor"))).alias("open"),
    ), "anchors")

    texts = docs.filter("doc_id is not null")
    undecided = texts.join(per_doc.filter("size(open) > 0").select("doc_id", "open"), "doc_id").select(
        "doc_id", "text", "open"
    ).mapInArrow(_undecided(width), "doc_id long, anchor long, window long")
    undecided = materialize(undecided, "open-windows")
    first = undecided.groupBy("anchor", "window").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    later = undecided.join(first.filter("low < high").drop("high"), ["anchor", "window"]).filter("doc_id > low")
    decided = per_doc.filter("size(gone) > 0").select("doc_id", "gone").join(
        later.groupBy("doc_id").agg(F.collect_set("window").alias("windows")), "doc_id", "full"
    )
    decided = materialize(decided, "repeats")
    changed = texts.join(decided, "doc_id").select("doc_id", "text", "gone", "windows").mapInArrow(
        _cut(width), RESULT + ", kept string"
    )
    result = base.join(decided.select("doc_id"), "doc_id", "left_anti").union(changed.select(base.columns))
    return result, changed.select("doc_id", "kept")
