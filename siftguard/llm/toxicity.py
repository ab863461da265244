"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned from the training rows: word beginnings that stand in many more toxic
documents than clean ones, with their log odds as weights. Further features are the nearness
of second-person words, capitals, punctuation and obfuscation. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftguard.llm.labels import held_out, labelled
from siftguard.llm.words import LOWER, NOT_ALNUM, Piece, mix, pieces, powers, _BYTE_CODES
from siftguard.session import materialize, spread

STEM_BYTES = range(4, 9)
NEAR = 5
WINDOW = 64

# Second-person words of the four languages of the corpus.
SECOND_PERSON = (
    "you your yours yourself ya du dich dir dein deine euch ihr tu toi te ton ta tes vous votre vos "
    "tú ti tuyo usted ustedes vosotros"
).split()

# Digits and signs that stand for letters, undone before words are looked up.
_PLAIN = LOWER.copy()
_PLAIN[list(b"013457@$")] = list(b"oieastas")
_OUTSIDE = NOT_ALNUM.copy()
_OUTSIDE[list(b"@$")] = False
_DIGIT_OR_SIGN = np.zeros(256, bool)
_DIGIT_OR_SIGN[[*range(0x30, 0x3A), *b"@$*"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True

FEATURES = (
    "lexicon_density", "lexicon_weight", "lexicon_hits", "lexicon_window", "second_person_density", "near_second_person",
    "capitals", "capital_words", "exclamations", "questions", "punctuation", "obfuscated_words", "obfuscated_hits",
)


def _stems(piece: Piece) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each stem length: which words are as long, and the hash of their first bytes."""
    lengths = piece.ends - piece.starts
    heads = np.cumsum(lengths) - lengths
    inside = np.arange(int(lengths.sum())) - np.repeat(heads, lengths)
    letters = piece.data[np.repeat(piece.starts, lengths) + inside]
    sums = np.zeros(len(inside) + 1, np.uint64)
    if len(inside):
        np.cumsum(_BYTE_CODES[letters] * powers(int(lengths.max()))[inside], out=sums[1:])
    for n in STEM_BYTES:
        at = np.flatnonzero(lengths >= n)
        yield at, mix(sums[heads[at] + n] - sums[heads[at]] + np.uint64(n))


def _plain(texts: pa.Array) -> Iterator[Piece]:
    """Pieces with lower case and look-alike signs undone."""
    for piece in pieces(texts, _OUTSIDE):
        yield replace(piece, data=_PLAIN[piece.data])


def _stem_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct stems of each labelled document."""
    for batch in batches:
        for piece in _plain(batch.column(1)):
            docs = piece.docs()
            for at, stems in _stems(piece):
                pairs = np.unique(np.stack([docs[at].astype(np.uint64), stems]), axis=1)
                rows = pairs[0].astype(np.int64) + piece.rows.start
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2).take(pa.array(rows)), pa.array(pairs[1].view(np.int64))], ["label", "stem"]
                )


def learn_lexicon(sample: DataFrame, least: int = 4, odds: float = 6.0, most: int = 4_096) -> tuple[np.ndarray, np.ndarray]:
    """Stem hashes, sorted, and weights: those with the strongest evidence, at most ``most``.

    Too few toxic documents leave the lexicon empty; its features are zero then.
    """
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return np.zeros(0, np.uint64), np.zeros(0)
    rows = sample.select("doc_id", "text", "label").mapInArrow(_stem_rows, "label int, stem long")
    toxic, clean = F.sum("label"), F.count("*") - F.sum("label")
    ratio = ((toxic + 0.5) / (n[1] + 1)) / ((clean + 0.5) / (n[0] + 1))
    found = (
        rows.groupBy("stem").agg(toxic.alias("toxic"), F.log(ratio).alias("weight"))
        .filter((F.col("toxic") >= least) & (F.col("weight") >= float(np.log(odds))))
        .orderBy(F.desc(F.col("weight") * F.log(F.col("toxic") + 1)), "stem").limit(most).collect()
    )
    stems = np.array([r["stem"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(stems)
    return stems[order], np.array([r["weight"] for r in found])[order]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return np.diff(total[bounds])


def _near(marks: np.ndarray, docs: np.ndarray, reach: int) -> np.ndarray:
    """Words with a marked word of their document at most ``reach`` words away."""
    out = marks.copy()
    for d in range(1, reach + 1):
        same = docs[d:] == docs[:-d]
        out[d:] |= marks[:-d] & same
        out[:-d] |= marks[d:] & same
    return out


def _features(stems: np.ndarray, weights: np.ndarray, persons: np.ndarray):
    filter_ = np.zeros(1 << 16, bool)
    filter_[(stems >> np.uint64(48)).astype(np.int64)] = True

    def look_up(piece: Piece) -> np.ndarray:
        """Weight of each word: that of its strongest stem."""
        out = np.zeros(len(piece.starts))
        for at, found in _stems(piece):
            likely = np.flatnonzero(filter_[(found >> np.uint64(48)).astype(np.int64)])
            if len(likely):
                place = np.searchsorted(stems, found[likely])
                place[place == len(stems)] = 0
                hit = stems[place] == found[likely]
                words = at[likely[hit]]
                out[words] = np.maximum(out[words], weights[place[hit]])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in pieces(batch.column(1), _OUTSIDE):
                piece = replace(raw, data=_PLAIN[raw.data])
                docs, first, n_docs = raw.docs(), raw.first, len(raw.rows)
                n_words = np.maximum(np.diff(first), 1)
                n_bytes = np.maximum(np.diff(raw.offsets), 1)
                word_weights = look_up(piece)
                hits = word_weights > 0
                hashes = piece.hashes()
                place = np.searchsorted(persons, hashes)
                place[place == len(persons)] = 0
                person = persons[place] == hashes if len(hashes) else hits
                running = np.zeros(len(hits) + 1)
                np.cumsum(word_weights, out=running[1:])
                ends = np.minimum(np.arange(len(hits)) + WINDOW, first[1:][docs] if len(docs) else 0)
                peaks = np.zeros(n_docs)
                np.maximum.at(peaks, docs, running[ends] - running[:-1])
                cut = lambda flags: _sums(flags, raw.offsets)
                at = np.zeros(len(raw.data) + 1)
                np.cumsum(_DIGIT_OR_SIGN[raw.data], out=at[1:])
                letters = np.zeros(len(raw.data) + 1)
                np.cumsum(_LETTER[raw.data], out=letters[1:])
                capitals = np.zeros(len(raw.data) + 1)
                np.cumsum(_CAPITAL[raw.data], out=capitals[1:])
                over = lambda x: x[raw.ends] - x[raw.starts]
                last_letter = _LETTER[raw.data[raw.ends - 1]] if len(raw.ends) else hits
                hidden = (over(at) > 0) & (over(letters) > 0) & last_letter
                shouted = (over(capitals) == over(letters)) & (over(capitals) > 1)
                n_hits = _sums(hits, first)
                columns = [
                    n_hits / n_words, _sums(word_weights, first) / n_words, np.log1p(n_hits), peaks,
                    _sums(person, first) / n_words, _sums(hits & _near(person, docs, NEAR), first) / np.maximum(n_hits, 1),
                    cut(_CAPITAL[raw.data]) / n_bytes, _sums(shouted, first) / n_words,
                    cut(raw.data == ord("!")) / n_bytes, cut(raw.data == ord("?")) / n_bytes,
                    cut(NOT_ALNUM[raw.data] & (raw.data > 32)) / n_bytes,
                    _sums(hidden, first) / n_words, _sums(hidden & hits, first) / n_words,
                ]
                flat = np.stack(columns, axis=1).ravel()
                part = batch.slice(raw.rows.start, n_docs)
                bounds = np.arange(n_docs + 1) * len(columns)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in range(part.num_columns) if i != 1],
                     pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))],
                    [*[x for i, x in enumerate(part.schema.names) if i != 1], "features"],
                )

    return run


def score_toxicity(
    docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, threshold: float = 0.3,
    training_rows: int = 12_000, trees: int = 20, depth: int = 4, lexicon: int = 4_096,
) -> DataFrame:
    """Calibrated probability that a document is toxic.

    Returns, per input row, doc_id, held_out, score (0 to 1) and predicted (1 from
    ``threshold``). The model learns from at most ``training_rows`` labelled documents that
    are not held out, chosen by hash: seven tenths for the lexicon (at most ``lexicon`` stems,
    those with the strongest evidence) and the trees, the rest for the calibration. A part
    that lacks one of the classes cannot do its work; all training rows do it then, and the
    trees' own rows calibrate them. Ids, sources, languages and labels are no features. Null and
    empty texts have features of zero and get the score of those. Only without training rows of
    both classes there is nothing to learn: every score is the share of toxic ones, 0 if there
    are none. Unlabelled, repeated and
    null ids are scored like any; repeated labels count each; other columns are ignored.
    """
    spark = docs.sparkSession
    sample = materialize(labelled(docs, labels, "toxic", folds, fold, training_rows), "toxic-sample")
    out = spread(docs.select("doc_id", "text"))
    fold_out = held_out(folds, fold)
    counts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    persons = np.sort(next(pieces(pa.array([" ".join(SECOND_PERSON)]), _OUTSIDE)).hashes())
    if not counts.get(0) or not counts.get(1):
        share = F.lit(float(counts.get(1, 0) / max(sum(counts.values()), 1)))
        return out.select("doc_id", fold_out.alias("held_out"), share.alias("score"), (share >= threshold).cast("int").alias("predicted"))

    def part(where: str) -> DataFrame:
        rows = sample.filter(where)
        return rows if len({r[0] for r in rows.select("label").distinct().collect()}) == 2 else sample

    stems, weights = learn_lexicon(part("part < 7"), most=lexicon)
    kernel = _features(stems, weights, persons)
    rows = materialize(
        sample.select("doc_id", "text", "label", "part").mapInArrow(
            kernel, "doc_id long, label int, part int, features array<double>")
        .withColumn("features", array_to_vector("features")).coalesce(4), "toxic-features",
    )
    sample = rows
    model = GBTClassifier(labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=1).fit(part("part < 7"))
    raw = vector_to_array("probability")[1]
    rest = part("part >= 7")
    scored = model.transform(rest).select(F.col("label").cast("double").alias("label"), raw.alias("raw"))
    steps = IsotonicRegression(featuresCol="raw", labelCol="label").fit(scored)
    features = out.mapInArrow(kernel, "doc_id long, features array<double>").withColumn("features", array_to_vector("features"))
    calibrated = steps.transform(model.transform(features).select("doc_id", raw.alias("raw")))
    score = F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0))
    return calibrated.select(
        "doc_id", fold_out.alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted")
    )
