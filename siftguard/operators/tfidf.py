"""TF-IDF feature space: tokens, vocabulary, weights and the combined vector."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftguard.functions.text import FEATURE_NAMES
from siftguard.session import materialize, spread

TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

# Common English words without content, in alphabetical order.
STOP_WORDS = """
about above after again against all am an and any are as at be because been before being
below between both but by can cannot could did do does doing down during each few for from
further had has have having he her here hers herself him himself his how if in into is it
its itself me more most my myself no nor not of off on once only or other ought our ours
ourselves out over own same she should so some such than that the their theirs them
themselves then there these they this those through to too under until up very was we were
what when where which while who whom why with would you your yours yourself yourselves
""".split()


def tokens(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Lower-cased tokens of two or more word characters, repeats kept."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*stop_words)) if stop_words else found


def tokenize_docs(df: DataFrame, text: str = "text", stop_words: list[str] = STOP_WORDS) -> DataFrame:
    return df.withColumn("tokens", tokens(F.col(text), stop_words))


def term_counts(tokenized: DataFrame, *by: str) -> DataFrame:
    """Corpus count and document count per term (and ``by``), in one shuffle with map-side sums."""
    pairs = F.concat(
        F.transform("tokens", lambda t: F.struct(t.alias("term"), F.lit(1).alias("n"), F.lit(0).alias("d"))),
        F.transform(
            F.array_distinct("tokens"),
            lambda t: F.struct(t.alias("term"), F.lit(0).alias("n"), F.lit(1).alias("d")),
        ),
    )
    return (
        tokenized.select(*by, F.explode(pairs).alias("p"))
        .groupBy(*by, F.col("p.term").alias("term"))
        .agg(F.sum("p.n").alias("total"), F.sum("p.d").alias("df"))
    )


def vocabulary_top_n(tokenized: DataFrame, size: int = 300) -> DataFrame:
    """The terms with the highest corpus count; ties in alphabetical order."""
    return term_counts(tokenized).orderBy(F.desc("total"), F.asc("term")).limit(size)


def tfidf_fit(tokenized: DataFrame, size: int = 300) -> DataFrame:
    """Vocabulary with smoothed inverse document frequency (at most ``size`` rows)."""
    docs = tokenized.agg(F.count(F.lit(1))).scalar()
    idf = F.ln((1.0 + docs) / (1.0 + F.col("df"))) + 1.0
    return vocabulary_top_n(tokenized, size).withColumn("idf", idf)


def fold_vocabularies(tokenized: DataFrame, folds: int, size: int = 300) -> list[list[tuple[str, float]]]:
    """Per fold the vocabulary that ``tfidf_fit`` finds on the rows of all other folds.

    The tokens are counted once, by fold; a fold's counts are the sums over the others.
    """
    docs = {r["fold"]: r["count"] for r in tokenized.groupBy("fold").count().collect()}
    sums = [
        F.sum(F.when(F.col("fold") != k, F.col(c))).alias(f"{c}_{k}") for k in range(folds) for c in ("total", "df")
    ]
    rows = spread(tokenized.select("fold", "tokens"))
    counts = materialize(term_counts(rows, "fold").groupBy("term").agg(*sums), "fold-terms")
    found = []
    for k in range(folds):
        others = sum(n for fold, n in docs.items() if fold is not None and fold != k)
        idf = F.ln((1.0 + F.lit(others)) / (1.0 + F.col(f"df_{k}"))) + 1.0
        top = counts.filter(F.col(f"total_{k}").isNotNull()).orderBy(F.desc(f"total_{k}"), F.asc("term")).limit(size)
        found.append(vocabulary_rows(top.select("term", F.col(f"total_{k}").alias("total"), idf.alias("idf"))))
    return found


def _weights(tokenized: DataFrame, vocabulary: list[tuple[str, float]]) -> DataFrame:
    """Dense weight array per document, in vocabulary order, without any shuffle."""
    model = CountVectorizerModel.from_vocabulary(
        [t for t, _ in vocabulary], inputCol="tokens", outputCol="__counts"
    )
    counted = model.transform(tokenized).withColumn("__tf", vector_to_array("__counts"))
    idf = F.array(*[F.lit(float(w)) for _, w in vocabulary])
    raw = F.zip_with(
        F.col("__tf"), idf, lambda tf, w: F.when(tf > 0, (1.0 + F.ln(tf)) * w).otherwise(0.0)
    )
    with_raw = counted.withColumn("__raw", raw)
    norm = F.sqrt(F.aggregate("__raw", F.lit(0.0), lambda a, x: a + x * x))
    with_norm = with_raw.withColumn("__norm", norm)
    scaled = F.transform("__raw", lambda x: F.when(F.col("__norm") > 0, x / F.col("__norm")).otherwise(0.0))
    return with_norm.withColumn("tfidf", scaled).drop("__counts", "__tf", "__raw", "__norm")


def vocabulary_rows(fitted: DataFrame) -> list[tuple[str, float]]:
    """The fitted vocabulary on the driver; bounded by the vocabulary size."""
    rows = fitted.orderBy(F.desc("total"), F.asc("term")).collect()
    return [(r["term"], r["idf"]) for r in rows]


def tfidf_transform(tokenized: DataFrame, vocabulary: list[tuple[str, float]], row_id: str) -> DataFrame:
    """Long form (id, term, weight) of the non-zero weights."""
    terms = F.array(*[F.lit(t) for t, _ in vocabulary])
    weighted = _weights(tokenized, vocabulary).withColumn("__terms", terms)
    pairs = F.filter(F.arrays_zip("__terms", "tfidf"), lambda p: p["tfidf"] > 0)
    return weighted.select(row_id, F.explode(pairs).alias("p")).select(
        row_id, F.col("p.__terms").alias("term"), F.col("p.tfidf").alias("weight")
    )


def assemble_features(tokenized: DataFrame, vocabulary: list[tuple[str, float]]) -> DataFrame:
    """One vector per document: TF-IDF weights, then the 15 identifier features."""
    extra = F.array(*[F.col(c) for c in FEATURE_NAMES])
    return _weights(tokenized, vocabulary).withColumn(
        "features", array_to_vector(F.concat("tfidf", extra))
    ).drop("tfidf", "tokens")


def word_columns(tokenized: DataFrame, vocabulary: list[tuple[str, float]]) -> tuple[DataFrame, list[str]]:
    """A column ``word_<term>`` per weight in place of the tokens, and the names of these columns."""
    names = [f"word_{t}" for t, _ in vocabulary]
    if not names:
        return tokenized.drop("tokens"), names
    weights = [F.col("tfidf")[i].alias(n) for i, n in enumerate(names)]
    kept = [c for c in tokenized.columns if c != "tokens"]
    return _weights(tokenized, vocabulary).select(*kept, *weights), names
