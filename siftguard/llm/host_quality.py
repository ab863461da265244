"""Quality rules judged by host.

Each document is measured and held against rules. Per host and rule the share of failures is
shrunk towards the corpus by a beta prior fitted to all hosts (method of moments), so that a
host with few documents is not judged by chance. A host whose shrunk share of failing
documents is high is blocked; where a host fails a single rule habitually, the rule is
enforced on its documents; elsewhere a failure is let pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftguard.llm.words import SPACES, mix, pieces, window_sums
from siftguard.session import materialize, spread

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

MEASURES = (
    "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, "
    "n_repeat_words long"
)

# Rules by name; each is true for a failing document.
RULES: dict[str, str] = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "dup_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
}
BASE = ("short", "repeats")


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[bounds])


def _repeat_words(codes: np.ndarray, docs: np.ndarray, first: np.ndarray, width: int = 3) -> np.ndarray:
    """Words per document in windows that stand in it twice or more."""
    n = len(codes) - width + 1
    marks = np.zeros(len(codes), bool)
    if n > 0:
        keys = mix(window_sums(codes, width) ^ mix(docs[:n].astype(np.uint64) + np.uint64(1)))
        at = np.flatnonzero(docs[:n] == docs[width - 1:])
        order = at[np.argsort(keys[at], kind="stable")]
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        for j in range(width):
            marks[order[twice] + j] = True
    return _per_doc(marks, first)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch.column(2)):
            letters = ~SPACES[piece.data] & ((piece.data & 0xC0) != 0x80)
            lines, copies = [], []
            raw = piece.data.tobytes()
            cuts = piece.offsets.tolist()
            for a, b in zip(cuts, cuts[1:]):
                found = [x for x in raw[a:b].split(b"\n") if x and not x.isspace()]
                lines.append(len(found))
                copies.append(len(found) - len(set(found)))
            part = batch.slice(piece.rows.start, len(piece.rows))
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.array(np.diff(piece.first), pa.int64()),
                pa.array(_per_doc(letters, piece.offsets)), pa.array(_per_doc(SYMBOLS[piece.data], piece.offsets)),
                pa.array(lines, pa.int64()), pa.array(copies, pa.int64()),
                pa.array(_repeat_words(piece.hashes(), piece.docs(), piece.first)), *part.columns[3:],
            ], [
                "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
                *part.schema.names[3:],
            ])


def measure(docs: DataFrame, host: str = "source", key: tuple[str, ...] = ()) -> DataFrame:
    """Counts that the rules use, one row per document; long columns of ``key`` go along."""
    schema = MEASURES + "".join(f", `{k}` long" for k in key)
    return spread(docs.select("doc_id", F.col(host).alias("host"), "text", *key)).mapInArrow(_measure, schema)


def _shrunk(failed: Column, n: Column, rate: Column, strength: Column) -> Column:
    return (failed + rate * strength) / (n + strength)


def host_rates(measured: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """Per host: documents, and the shrunk share of failures of each rule and of any rule.

    The prior of a rule has the corpus rate as its mean; its strength (how many documents it
    is worth) follows from the variance between hosts beyond what chance explains, within 1
    and 1,000,000. A null host is a host.
    """
    failing = {**rules, "any": " or ".join(f"({r})" for r in rules.values())}
    counts = measured.groupBy("host").agg(
        F.count("*").alias("n"),
        *[F.sum(F.expr(f"CASE WHEN {rule} THEN 1 ELSE 0 END")).alias(f"f_{name}") for name, rule in failing.items()],
    )
    counts = materialize(counts, "host-counts")
    rates = counts.agg(
        F.sum("n").alias("total"), F.count("*").alias("hosts"),
        *[(F.sum(f"f_{name}") / F.sum("n")).alias(f"m_{name}") for name in failing],
    )
    spreads = counts.crossJoin(F.broadcast(rates)).groupBy().agg(
        F.max("total").alias("total"), F.max("hosts").alias("hosts"),
        *[F.max(f"m_{name}").alias(f"m_{name}") for name in failing],
        *[F.sum(F.col("n") * F.pow(F.col(f"f_{name}") / F.col("n") - F.col(f"m_{name}"), F.lit(2.0))).alias(f"v_{name}") for name in failing],
    )

    def strength(name: str) -> Column:
        chance = F.col(f"m_{name}") * (1 - F.col(f"m_{name}"))
        between = F.col(f"v_{name}") / F.col("total") - chance * F.col("hosts") / F.col("total")
        return F.when(between > 0, F.least(F.greatest(chance / between - 1, F.lit(1.0)), F.lit(1e6))).otherwise(F.lit(1e6))

    # One row of prior parameters.
    prior = spreads.select(
        *[F.col(f"m_{name}") for name in failing], *[strength(name).alias(f"s_{name}") for name in failing]
    )
    return counts.crossJoin(F.broadcast(prior)).select(
        "host", "n",
        *[_shrunk(F.col(f"f_{x}"), F.col("n"), F.col(f"m_{x}"), F.col(f"s_{x}")).alias(f"rate_{x}") for x in failing],
    )


def judge(
    docs: DataFrame, host: str = "source", rules: dict[str, str] = RULES, block: float = 0.5, enforce: float = 0.02,
    key: tuple[str, ...] = (),
) -> DataFrame:
    """Verdict on every document by its host's record.

    Returns, per input row, doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed and kept. Words are runs of characters other than ASCII white
    space; word_chars their code points; n_dup_lines the lines with a word that equal an
    earlier line; n_repeat_words the words in three-word windows that stand twice or more in
    the text. base_failed: fewer than 50 words, or over half of them repeated. kept is false
    for these, for all documents of hosts whose shrunk share of failing documents is at least
    ``block``, and for documents that fail a rule whose shrunk share at their host is at
    least ``enforce``. Null and empty texts have no words and fail. A null host is a host;
    repeated rows and ids count each; other columns are ignored. Long columns named in ``key``
    are returned as well, so that a verdict can be joined to its row.
    """
    measured = materialize(measure(docs, host, key), "quality-measures")
    rates = host_rates(measured, rules).withColumnRenamed("host", "of")
    base = " or ".join(f"({rules[name]})" for name in BASE)
    enforced = reduce(lambda a, b: a | b, [F.expr(rule) & (F.col(f"rate_{x}") >= enforce) for x, rule in rules.items()])
    return measured.join(rates, F.col("host").eqNullSafe(F.col("of"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.expr(base).alias("base_failed"),
        (~F.expr(base) & (F.col("rate_any") < block) & ~enforced).alias("kept"), *key,
    )
