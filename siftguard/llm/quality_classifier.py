"""Quality classifier: supervised subword embeddings.

Words, character n-grams of words, and word n-grams that come again in a text hash to
buckets, each with a learned vector. A document is the average of its vectors; a softmax layer
gives the classes. Vectors and layer are trained together by stochastic gradient descent in
numpy, on a bounded sample. As the layer is linear, scoring needs one number per bucket: the
difference that its vector makes to the two classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftguard.llm.labels import held_out, labelled
from siftguard.llm.words import SPACES, Piece, mix, pieces, window_sums, _BYTE_CODES
from siftguard.session import materialize, spread

BUCKET_BITS = 18
GRAMS = (3, 4)
# How much more a word n-gram that comes again weighs than a word.
AGAIN_WEIGHT = 12.0


def _again(piece: Piece, codes: np.ndarray, width: int = 3) -> np.ndarray:
    """Word n-grams that stand in their document twice or more, counted per document."""
    docs = piece.docs()
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(len(piece.rows))
    keys = mix(window_sums(codes, width) ^ mix(docs[:n].astype(np.uint64) + np.uint64(1)))
    at = np.flatnonzero(docs[:n] == docs[width - 1:])
    _, back, counts = np.unique(keys[at], return_inverse=True, return_counts=True)
    return np.bincount(docs[at[counts[back] > 1]], minlength=len(piece.rows)).astype(float)


def _buckets(piece: Piece) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket and document of words and of character n-grams that do not cross a space."""
    top = np.uint64(64 - BUCKET_BITS)
    yield (piece.hashes() >> top).astype(np.int64), piece.docs()
    blank = SPACES[piece.data]
    codes = np.where(blank, np.uint64(32), _BYTE_CODES[piece.data])
    owner = np.repeat(np.arange(len(piece.rows)), np.diff(piece.offsets))
    spaces = np.concatenate(([0], np.cumsum(blank)))
    for n in GRAMS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        inner = spaces[n - 1: n - 1 + m] == spaces[1: 1 + m]
        at = np.flatnonzero(inner & (owner[:m] == owner[n - 1:]))
        yield (mix(window_sums(codes, n) + np.uint64(n))[at] >> top).astype(np.int64), owner[at]


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of each labelled document with their shares of its n-grams."""
    for batch in batches:
        for piece in pieces(batch.column(1), size=200_000):
            parts = list(_buckets(piece))
            keys = np.concatenate([doc << BUCKET_BITS | bucket for bucket, doc in parts])
            again = _again(piece, piece.hashes()) * AGAIN_WEIGHT
            found, counts = np.unique(keys, return_counts=True)
            docs, buckets = found >> BUCKET_BITS, (found & ((1 << BUCKET_BITS) - 1)).astype(np.int32)
            total = np.bincount(docs, counts, len(piece.rows)) + again
            bounds = np.searchsorted(docs, np.arange(len(piece.rows) + 1))
            shares = (counts / total[docs]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([
                *[batch.column(i).slice(piece.rows.start, len(piece.rows)) for i in (0, 2)],
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(buckets)),
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(shares)),
                pa.array((again / np.maximum(total, 1)).astype(np.float32)),
            ], ["doc_id", "label", "buckets", "shares", "again"])


def train(bags: pa.Table, dim: int = 8, epochs: int = 6, rate: float = 1.0, seed: int = 1) -> np.ndarray:
    """Per bucket the difference of the two classes' logits; the last entries are that of a word n-gram again, and the bias."""
    rng = np.random.default_rng(seed)
    size = 1 << BUCKET_BITS
    vectors = rng.uniform(-1 / dim, 1 / dim, (size + 1, dim)).astype(np.float32)
    layer, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    table = bags.sort_by([("doc_id", "ascending"), ("label", "ascending")]).combine_chunks()
    labels = table.column("label").to_numpy()
    buckets, shares = (table.column(c).combine_chunks() for c in ("buckets", "shares"))
    bounds = buckets.offsets.to_numpy()
    flat, weight = buckets.values.to_numpy(), shares.values.to_numpy()
    again = table.column("again").to_numpy()
    steps, step = epochs * len(labels), 0
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            lr = rate * (1 - step / steps)
            step += 1
            at, w = flat[bounds[i]: bounds[i + 1]], weight[bounds[i]: bounds[i + 1]]
            hidden = w @ vectors[at] + again[i] * vectors[size]
            logits = layer @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ layer
            layer -= lr * np.outer(p, hidden)
            bias -= lr * 0.1 * p
            vectors[at] -= lr * w[:, None] * back
            vectors[size] -= lr * again[i] * back
    return np.append(vectors @ (layer[1] - layer[0]), bias[1] - bias[0]).astype(np.float64)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = shared.value
        for batch in batches:
            for piece in pieces(batch.column(1)):
                n = len(piece.rows)
                again = _again(piece, piece.hashes()) * AGAIN_WEIGHT
                total, sums = again.copy(), again * values[-2]
                for buckets, docs in _buckets(piece):
                    sums += np.bincount(docs, values[buckets], n)
                    total += np.bincount(docs, minlength=n)
                logits = sums / np.maximum(total, 1) + values[-1]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(piece.rows.start, n), pa.array(1 / (1 + np.exp(-np.clip(logits, -60, 60)))),
                ], ["doc_id", "score"])

    return run


def score_quality(
    docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, threshold: float = 0.5, training_rows: int = 4_000
) -> DataFrame:
    """Probability that a document is of good quality.

    Returns, per input row, doc_id, held_out, score (0 to 1) and predicted (1 from
    ``threshold``). The model learns from at most ``training_rows`` labelled documents that
    are not held out, chosen by hash; their n-gram counts go to the driver, which trains. Ids,
    sources, languages and labels are no features. Null and empty texts have no n-grams and
    get the score of the bias. Without training rows every score is 0.5. Unlabelled, repeated
    and null ids are scored like any; other columns are ignored.
    """
    spark = docs.sparkSession
    sample = labelled(docs, labels, "quality", folds, fold, training_rows)
    bags = materialize(
        sample.select("doc_id", "text", "label").mapInArrow(_bags, "doc_id long, label int, buckets array<int>, shares array<float>, again float"),
        "quality-bags",
    ).toArrow()
    values = train(bags) if bags.num_rows else np.zeros((1 << BUCKET_BITS) + 2)
    shared = spark.sparkContext.broadcast(values)
    scored = spread(docs.select("doc_id", "text")).mapInArrow(_score(shared), "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
