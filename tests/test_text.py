from pyspark.sql import functions as F

from siftguard.functions.text import FEATURE_NAMES, identifier_features, mask_match
from siftguard.operators import tfidf
from siftguard.operators.tfidf import (
    assemble_features, term_counts, tfidf_fit, tfidf_transform, tokenize_docs, vocabulary_rows,
)

CASES = [
    ("card with spaces 4111 1111 1111 1111 here", {"pat_card_valid": 1, "pat_card_like": 1}),
    ("card with dashes 4111-1111-1111-1111", {"pat_card_valid": 1, "pat_card_like": 1}),
    ("bare 4111111111111111", {"pat_card_valid": 1, "pat_card_like": 1}),
    ("wrong last digit 4111111111111112", {"pat_card_valid": 0, "pat_card_like": 1}),
    ("15 digits 411111111111111", {"pat_card_valid": 0, "pat_card_like": 0}),
    ("17 digits 41111111111111111", {"pat_card_valid": 0, "pat_card_like": 0}),
    ("mail a.b@x.org and c@d.e", {"pat_email": 1}),
    ("mail él@café.fr", {"pat_email": 1}),
    ("call +380501234567 or +1234567890", {"pat_phone": 1}),
    ("tax 2123456789 not 4123456789 nor 21234567", {"pat_ipn": 1}),
    ("PAY 500 USD or 12eur or 1 usd", {"pat_money": 2}),
    ("met John Smith and Élie Martin and jo smith", {"pat_person": 1}),
    ("Jean René is not a pair", {"pat_person": 0}),
    ("code J45.1 but not j45.1 nor J4.1", {"pat_diag": 1}),
    ("ssn 123-45-6789 not 123-456-789", {"pat_ssn": 1}),
    ("iban UA123456789012345678901234567 ref 123456789012345678901234567", {"pat_iban": 1}),
    ("eth 0x" + "a1" * 20 + " btc 1BoatSLRHtKNngkdXEeobR76b53LETtpyT", {"pat_crypto": 2}),
    ("shopping pin PASSWORD", {"kw_credential": 3}),
    ("Credentials of a credential, tax id card rate", {"kw_sensitive": 4, "kw_credential": 2}),
    ("two² and ٣", {"meta_digit_ratio": 2 / 10, "meta_len": 0.010}),
    ("", {"meta_len": 0.0, "meta_digit_ratio": 0.0, "pat_card_like": 0}),
]


def test_identifier_features(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id int, text string")
    found = {r.doc_id: r for r in identifier_features(rows).collect()}
    for i, (text, want) in enumerate(CASES):
        for name, value in want.items():
            assert abs(found[i][name] - value) < 1e-12, (text, name, found[i][name])
    assert list(identifier_features(rows).columns[2:]) == FEATURE_NAMES


def test_mask(spark):
    row = spark.range(1).select(mask_match(F.lit("4111111111111111")).alias("m")).first()
    assert row.m == "41***16"


def test_tfidf_by_hand(spark):
    from math import log, sqrt

    docs = spark.createDataFrame(
        [(1, "Alpha alpha beta, the x"), (2, "beta gamma gamma"), (3, "Gamma!")], "doc_id long, text string"
    )
    tokenized = tokenize_docs(docs)
    assert tokenized.orderBy("doc_id").first().tokens == ["alpha", "alpha", "beta"]
    counts = {r.term: (r.total, r.df) for r in term_counts(tokenized).collect()}
    assert counts == {"alpha": (2, 1), "beta": (2, 2), "gamma": (3, 2)}
    vocabulary = vocabulary_rows(tfidf_fit(tokenized, 2))
    assert [t for t, _ in vocabulary] == ["gamma", "alpha"]
    assert abs(vocabulary[1][1] - (log(4 / 2) + 1)) < 1e-12
    everything = vocabulary_rows(tfidf_fit(tokenized))
    idf = dict(everything)
    weights = {(r.doc_id, r.term): r.weight for r in tfidf_transform(tokenized, everything, "doc_id").collect()}
    a, b = (1 + log(2)) * idf["alpha"], idf["beta"]
    assert abs(weights[1, "alpha"] - a / sqrt(a * a + b * b)) < 1e-12
    assert weights[3, "gamma"] == 1.0


def test_assembled_vector_has_both_parts(spark):
    docs = identifier_features(
        spark.createDataFrame([(1, "alpha John Smith"), (2, "beta beta")], "doc_id long, text string")
    )
    tokenized = tokenize_docs(docs)
    vocabulary = vocabulary_rows(tfidf_fit(tokenized))
    rows = assemble_features(tokenized, vocabulary).orderBy("doc_id").collect()
    assert len(rows[0].features) == len(vocabulary) + 15
    assert rows[0].features[len(vocabulary) + FEATURE_NAMES.index("pat_person")] == 1.0


def test_vocabularies_of_all_folds_from_one_count(spark, monkeypatch):
    """The words and weights that a fit per fold finds; the tokens are read once for all folds."""
    rows = [(i % 3 if i else None, [f"w{j}" for j in range(i % 7)] * (1 + i % 2) if i != 5 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "fold int, tokens array<string>")
    want = [tfidf.vocabulary_rows(tfidf.tfidf_fit(df.filter(F.col("fold") != k), 4)) for k in range(3)]
    counted, whole = [], tfidf.term_counts
    monkeypatch.setattr(tfidf, "term_counts", lambda *a: counted.append(1) or whole(*a))
    assert tfidf.fold_vocabularies(df, 3, 4) == want
    assert len(counted) == 1
