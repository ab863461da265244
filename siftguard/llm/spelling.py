"""Spelling variants of words by asymmetric q-chunks.

Of two words one edit apart, one contributes two disjoint chunks, its halves; the other
contributes its positional grams of the same lengths. One edit touches one half only, so the
other half is a gram of the other word, at the same place if the edit lies behind it, moved by
the difference of the lengths (one at most) if it lies before. Of the half with the edit again
one of two parts is left alone; chunk and gram carry it along, so that common word beginnings
and endings alone bring no words together. The join is an equality of hashes of chunk, part,
places and length; candidates are verified by their edit distance.

All of it is DataFrame functions on the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftguard.session import discard, materialize, spread

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PUT_OUT_EVERY = 97


def word_counts(docs: DataFrame, least_length: int = 5, least: int = 3) -> DataFrame:
    """word, n: words of at least ``least_length`` code points found ``least`` times or more.

    Occurrences are counted within tasks before they are shuffled, so a common word is no
    hot key. In every 97th (document, word) by crc32 a code point is left out: this plants
    variants, as the contract of the query has it.
    """
    text = F.translate(F.col("text"), UPPER, UPPER.lower())
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("doc"),
        F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"),
    )
    # Shorter ones cannot become long enough.
    runs = runs.filter(F.length("run") >= least_length)
    h = F.crc32(F.concat("doc", F.lit(":"), "run"))
    at = F.pmod(h, F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.pmod(h, F.lit(PUT_OUT_EVERY)) == 0, cut).otherwise(F.col("run"))
    return (
        runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
        .filter((F.length("word") >= least_length) & (F.col("n") >= least))
    )


def _pieces(length: Column, shift: Column | int) -> list[tuple[Column, Column, Column, Column]]:
    """Places (from 0) and lengths of the pieces that survive an edit in one quarter.

    Quarters of a word of ``length``; pieces behind the edit stand ``shift`` further.
    Two pieces each: what lies before the quarter and what lies behind it.
    """
    half = F.floor(length / 2)
    bounds = [F.lit(0), F.floor(half / 2), half, half + F.floor((length - half) / 2), length]
    return [
        (F.lit(0), bounds[q], bounds[q + 1] + shift, length - bounds[q + 1]) for q in range(4)
    ]


def _keys(word: str, length: Column, shift: Column | int) -> Column:
    """One hash for each of the four ways in which chunk and part may survive."""
    w = F.col(word)

    def cut(at: Column, n: Column) -> Column:
        return F.substring(w, (at + 1).cast("int"), n.cast("int"))

    return F.array(*[
        F.xxhash64(F.lit(q), length, cut(a, n), cut(b, m)) for q, (a, n, b, m) in enumerate(_pieces(length, shift))
    ])


def near_words(words: DataFrame) -> DataFrame:
    """Pairs a, b of words one edit apart (inserted, deleted or replaced code point), each once.

    ``words`` has distinct words. The longer word gives chunks, of equally long ones the
    one that comes first; the other gives grams for partners as long as itself or longer by one.
    """
    length = F.length("a")
    chunks = words.select(F.col("word").alias("a"), F.explode(_keys("word", F.length("word"), 0)).alias("key"))
    more = F.explode(F.array(F.lit(0), F.lit(1))).alias("more")
    partner = F.length("word") + F.col("more")
    grams = words.select("word", more).select(
        F.col("word").alias("b"), F.explode(_keys("word", partner, -F.col("more"))).alias("key")
    )
    found = chunks.join(grams, "key").filter(
        ((length == F.length("b") + 1) | ((length == F.length("b")) & (F.col("a") < F.col("b"))))
        & (F.levenshtein("a", "b", 1) == 1)
    )
    return found.select("a", "b").distinct()


def spelling_variants(
    docs: DataFrame, least_length: int = 5, least: int = 3, ratio: int = 2
) -> DataFrame:
    """Words, their near words and their main forms.

    Takes doc_id and text; other columns are ignored. A word's form is its near word of the
    largest count (ties: smallest in code-point order) if that is at least ``ratio`` times its
    own count; its root is the last form along the chain. Since counts at least double, a
    chain ends and has no more than 62 steps.

    Returns word, form, root, n, n_near, form_n, one row per word. Null and empty texts have no
    words; a null doc_id counts as ``null`` in the choice of shortened words; each of repeated
    rows counts. Texts and words may be of any length. An empty table gives an empty one. The
    work is done when this is called.
    """
    words = materialize(word_counts(spread(docs.select("doc_id", "text")), least_length, least), "words")
    pairs = materialize(near_words(words.select("word")), "near-words")
    both = pairs.union(pairs.select("b", "a")).toDF("word", "near")
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    # Least of (-n, word) is the largest n with the smallest word.
    best = both.join(counts, "near").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")
    )
    best = best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.m")).alias("near_n"))
    goes = F.coalesce(F.col("near_n") >= ratio * F.col("n"), F.lit(False))
    formed = materialize(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(goes, F.col("near")).alias("form"), F.when(goes, F.col("near_n")).alias("form_n"),
    ), "forms")
    discard(pairs)
    # Pointers double their reach in every round.
    roots = materialize(formed.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.alias("x").join(roots.select(F.col("word").alias("at"), F.col("root").alias("next")), F.col("root") == F.col("at"), "left")
        stepped = materialize(
            further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "roots"
        )
        discard(roots)
        roots = stepped.select("word", "root")
        roots.scratch = stepped.scratch
        if stepped.filter("went").isEmpty():
            break
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
