"""Registered queries on documents: identifiers, TF-IDF, rules and classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftguard.functions.text import (
    CREDENTIAL_WORDS,
    FEATURE_NAMES,
    PATTERNS,
    SENSITIVE_WORDS,
    identifier_features,
    is_card_number,
    mask_match,
    pattern_matches,
)
from siftguard.operators import classifiers, metrics, rule_search, rules, sampling, tfidf
from siftguard.plans.common import event_stream, query, r6, stream_sql, table, texts
from siftguard.session import keep_hot, scratch_path
from siftguard.sources import readers

SENSITIVE_SOURCES = ["src1", "src2", "src3"]
OTHER_SOURCES = ["src4", "src5", "src6", "src7", "src8", "src9", "src10"]

# A hand-written policy over the identifier features.
POLICY: rules.RuleSet = [
    [("pat_card_valid", 1, 0.0)],
    [("pat_email", 1, 0.0), ("meta_digit_ratio", 1, 0.001)],
    [("pat_person", 1, 0.5), ("kw_sensitive", 1, 0.0)],
    [("meta_len", 1, 8.0), ("meta_digit_ratio", -1, 0.0005)],
]
EXPERT_RULE: rules.Rule = [("pat_card_like", 1, 0.0)]

# --- SQL building blocks --------------------------------------------------------

_SHAPE = r"regexp_replace(text, '[\x{00C0}-\x{024F}]', '_', 'g')"


def _count_sql(name: str) -> str:
    subject = "lower(shape)" if name == "pat_money" else "shape"
    return f"len(regexp_extract_all({subject}, '{PATTERNS[name]}'))"


def _words_sql(words: list[str]) -> str:
    return " + ".join(
        f"(length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)}" for w in words
    )


_LUHN = """len(list_filter(list_transform(
        regexp_extract_all(shape, '%s'), lambda m: regexp_replace(m, '[^0-9]', '', 'g')),
      lambda d: length(d) = 16 AND list_sum(list_transform(range(1, 17), lambda i:
        CASE WHEN i %% 2 = 0 THEN CAST(d[i] AS INTEGER)
             WHEN CAST(d[i] AS INTEGER) < 5 THEN 2 * CAST(d[i] AS INTEGER)
             ELSE 2 * CAST(d[i] AS INTEGER) - 9 END)) %% 10 = 0))""" % PATTERNS["pat_card_like"]

_COUNTS = {"pat_card_valid": _LUHN, **{p: _count_sql(p) for p in PATTERNS}}
_COUNTS["kw_sensitive"] = _words_sql(SENSITIVE_WORDS)
_COUNTS["kw_credential"] = _words_sql(CREDENTIAL_WORDS)
_COUNTS["meta_len"] = "length(text) / 1000.0"
_COUNTS["meta_digit_ratio"] = "length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1)"

FEATURES_SQL = (
    f"shaped AS (SELECT doc_id, text, lang, source, {_SHAPE} AS shape FROM documents),\n"
    "feat AS (SELECT doc_id, lang, source,\n  "
    + ",\n  ".join(f"CAST({_COUNTS[f]} AS DOUBLE) AS {f}" for f in FEATURE_NAMES)
    + "\n  FROM shaped),\n"
    "lab AS (SELECT feat.*, toxic AS label FROM feat JOIN labels USING (doc_id))"
)


def _fire_sql(rule: rules.Rule) -> str:
    return "(" + " AND ".join(f"{f} {'>' if op > 0 else '<'} {t!r}" for f, op, t in rule) + ")"


def _decide_sql(ruleset: rules.RuleSet) -> str:
    return "CASE WHEN " + " OR ".join(_fire_sql(r) for r in ruleset) + " THEN 1 ELSE 0 END"


def _with(body: str, *more: str, features: bool = True) -> str:
    parts = ([FEATURES_SQL] if features else []) + list(more)
    return "WITH " + ",\n".join(parts) + "\n" + body


_FOLD_SQL = "CAST('0x' || substr(md5('{seed}:' || {id}), 1, 8) AS BIGINT) % {k}"


def fold_sql(row_id: str = "doc_id", k: int = 5, seed: int = 42) -> str:
    return _FOLD_SQL.format(id=row_id, k=k, seed=seed)


# --- inputs -----------------------------------------------------------------------


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifier_features(texts(spark, sf_dir, "lang", "source")).drop("text")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the labelled documents; labels are joined before the text work."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    docs = texts(spark, sf_dir, "lang", "source").join(labels, "doc_id")
    return identifier_features(docs).drop("text")


# --- sources, filters, labels, samples ---------------------------------------------


@query(
    "read_mask_corpus",
    _with(
        "SELECT doc_id, n_masks, length(text) AS n_chars, CASE WHEN n_cards > 0 THEN 1 ELSE 0 END AS label FROM m",
        f"""m AS (SELECT doc_id, text, len(regexp_extract_all(shape, '{PATTERNS['pat_card_like']}')) AS n_cards,
          len(regexp_extract_all(shape, '{PATTERNS['pat_card_like']}'))
          + len(regexp_extract_all(shape, '{PATTERNS['pat_email']}')) AS n_masks
          FROM shaped WHERE lang = 'en')""",
    ),
)
def read_mask_corpus(spark, sf_dir):
    """Write the documents as annotated JSON lines, read the English ones back."""
    docs = texts(spark, sf_dir, "lang")
    path = scratch_path(spark, "masked")
    docs.select(
        "doc_id", F.col("text").alias("source_text"), F.col("lang").alias("language"),
        F.concat(_annotations("pat_card_like", "CREDITCARDNUMBER"), _annotations("pat_email", "EMAIL")).alias(
            "privacy_mask"
        ),
    ).write.json(path)
    corpus = sampling.label_by_critical_entity(readers.read_mask_corpus(spark, path, "en"))
    return corpus.select(
        "doc_id", F.size("privacy_mask").alias("n_masks"), F.length("source_text").alias("n_chars"), "label"
    )


@query(
    "read_numeric_stream",
    stream_sql(
        "SELECT stream_id, pos, f0, f1, f2, y FROM cls",
        """cls AS (SELECT st.stream_id, pos, f0, f1, f2,
          dense_rank() OVER (PARTITION BY st.stream_id ORDER BY k2) - 1 AS y
          FROM (SELECT *, 'c' || (f2 % 7) AS k2 FROM st) st)""",
    ),
)
def read_numeric_stream(spark, sf_dir):
    """Class labels such as 'c3.0' become a dense index per stream."""
    base = event_stream(spark, sf_dir)
    rows = base.select(
        "stream_id", "pos", *[F.col("features")[i].alias(f"f{i}") for i in range(3)]
    ).withColumn("kind", F.concat(F.lit("c"), (F.col("f2") % 7).cast("string")))
    stream = readers.numeric_stream(rows, "stream_id", "pos", ["f0", "f1", "f2"], "kind")
    return stream.select("stream_id", "pos", *[F.col("features")[i].alias(f"f{i}") for i in range(3)], "y")


_STRIPPED = r"regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')"


@query(
    "keep_long_docs",
    f"SELECT doc_id, length({_STRIPPED}) AS n, md5({_STRIPPED}) AS digest FROM documents "
    f"WHERE length({_STRIPPED}) > 80",
)
def keep_long_docs(spark, sf_dir):
    kept = sampling.keep_long_docs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.length("text").alias("n"), F.md5("text").alias("digest"))


def _in(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


@query(
    "label_by_topic",
    f"SELECT doc_id, source, CASE WHEN source IN {_in(SENSITIVE_SOURCES)} THEN 1 ELSE 0 END AS label "
    f"FROM documents WHERE source IN {_in(SENSITIVE_SOURCES + OTHER_SOURCES)}",
)
def label_by_topic(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sampling.label_by_topic(docs, "source", SENSITIVE_SOURCES, OTHER_SOURCES)


@query(
    "label_by_critical_entity",
    _with(
        "SELECT doc_id, CASE WHEN pat_card_valid > 0 OR pat_iban > 0 THEN 1 ELSE 0 END AS label FROM feat"
    ),
)
def label_by_critical_entity(spark, sf_dir):
    """Annotations from the identifier patterns; valid cards and IBANs are critical."""
    docs = texts(spark, sf_dir)
    text = F.col("text")

    def mask(found, label):
        return F.transform(found, lambda m: F.struct(F.lit(label).alias("label"), m.alias("value")))

    annotated = docs.select(
        "doc_id",
        F.concat(
            mask(F.filter(pattern_matches("pat_card_like", text), is_card_number), "CREDITCARDNUMBER"),
            mask(pattern_matches("pat_iban", text), "IBAN"),
            mask(pattern_matches("pat_email", text), "EMAIL"),
            mask(pattern_matches("pat_person", text), "FULLNAME"),
        ).alias("privacy_mask"),
    )
    return sampling.label_by_critical_entity(annotated).select("doc_id", "label")


_HASH = "md5('42:' || doc_id)"


@query(
    "stratified_sample",
    f"""WITH r AS (SELECT doc_id, toxic AS label,
        row_number() OVER (PARTITION BY toxic ORDER BY {_HASH}) AS rk FROM labels),
      p AS (SELECT least(count(*), 90) AS n FROM r WHERE label = 1)
      SELECT doc_id, label FROM r, p WHERE (label = 1 AND rk <= 90) OR (label = 0 AND rk <= 300 - n)""",
)
def stratified_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return sampling.stratified_sample(rows, "label", "doc_id", 300).select("doc_id", "label")


@query(
    "stratified_folds",
    f"""SELECT doc_id, toxic AS label, CAST({fold_sql()} AS INTEGER) AS fold,
        CAST((row_number() OVER (PARTITION BY toxic ORDER BY {_HASH}) - 1) % 5 AS INTEGER) AS exact_fold
        FROM (SELECT doc_id, toxic FROM documents LEFT JOIN labels USING (doc_id))""",
)
def stratified_folds(spark, sf_dir):
    """Folds of all documents; those without a label are a class of their own."""
    ids = table(spark, sf_dir, "documents").select("doc_id")
    rows = ids.join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.col("toxic").alias("label"))
    quick = sampling.stratified_folds(rows, "label", "doc_id")
    exact = sampling.stratified_folds(quick.withColumnRenamed("fold", "quick"), "label", "doc_id", exact=True)
    return exact.select("doc_id", "label", F.col("quick").alias("fold"), F.col("fold").alias("exact_fold"))


@query(
    "exclude_chosen",
    f"SELECT doc_id, source FROM documents WHERE doc_id NOT IN "
    f"(SELECT doc_id FROM labels WHERE {fold_sql()} < 2)",
)
def exclude_chosen(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    chosen = sampling.stratified_folds(
        table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")), "label", "doc_id"
    ).filter("fold < 2")
    return sampling.exclude_chosen(docs, chosen, "doc_id")


# --- identifiers -------------------------------------------------------------------


@query(
    "doc_identifier_features",
    _with(
        "SELECT doc_id, "
        + ", ".join(FEATURE_NAMES[:-1])
        + ", round(meta_digit_ratio, 9) AS meta_digit_ratio FROM feat"
    ),
)
def doc_identifier_features(spark, sf_dir):
    found = identifier_features(texts(spark, sf_dir)).drop("text")
    return found.withColumn("meta_digit_ratio", F.round("meta_digit_ratio", 9))


_HIT_KINDS = ["pat_card_like", "pat_email", "pat_phone", "pat_ipn", "pat_ssn", "pat_iban", "pat_crypto", "pat_person"]


def _hits_sql() -> str:
    parts = [
        f"SELECT doc_id, lang, source, '{k}' AS kind, unnest(regexp_extract_all(shape, '{PATTERNS[k]}')) AS hit FROM shaped"
        for k in _HIT_KINDS
    ]
    return "hits AS (" + "\nUNION ALL ".join(parts) + ")"


def _annotations(kind: str, label: str, value: str = "value") -> Column:
    """Matches of a pattern as structs with a label."""
    return F.transform(
        pattern_matches(kind, F.col("text")), lambda m: F.struct(F.lit(label).alias("label"), m.alias(value))
    )


def identifier_hits_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: every match with its kind, masked."""
    docs = texts(spark, sf_dir, "lang", "source")
    found = F.concat(*[_annotations(k, k, "hit") for k in _HIT_KINDS])
    return docs.select("doc_id", "lang", "source", F.explode(found).alias("h")).select(
        "doc_id", "lang", "source", F.col("h.label").alias("kind"), mask_match(F.col("h.hit")).alias("masked")
    )


@query(
    "identifier_hits",
    _with(
        "SELECT doc_id, kind, substr(hit, 1, 2) || '***' || length(hit) AS masked, count(*) AS n "
        "FROM hits GROUP BY ALL",
        _hits_sql(),
    ),
)
def identifier_hits(spark, sf_dir):
    rows = identifier_hits_rows(spark, sf_dir)
    return rows.groupBy("doc_id", "kind", "masked").agg(F.count(F.lit(1)).alias("n"))


@query(
    "identifier_summary",
    _with(
        "SELECT lang, source, kind, count(*) AS n_hits, count(DISTINCT doc_id) AS n_docs FROM hits GROUP BY ALL",
        _hits_sql(),
    ),
)
def identifier_summary(spark, sf_dir):
    rows = identifier_hits_rows(spark, sf_dir)
    return rows.groupBy("lang", "source", "kind").agg(
        F.count(F.lit(1)).alias("n_hits"), F.count_distinct("doc_id").alias("n_docs")
    )


# --- TF-IDF --------------------------------------------------------------------------

_STOP = _in(tfidf.STOP_WORDS)
TOKENS_SQL = (
    f"toks AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '{tfidf.TOKEN_PATTERN}'), "
    f"lambda t: t NOT IN {_STOP}) AS tokens FROM documents)"
)
_TRAIN = f"train AS (SELECT * FROM toks WHERE {fold_sql()} <> 0)"
_TERMS = "terms AS (SELECT doc_id, unnest(tokens) AS term FROM train)"
_VOCAB = (
    "vocab AS (SELECT term, count(*) AS total, count(DISTINCT doc_id) AS df FROM terms GROUP BY term "
    "ORDER BY total DESC, term LIMIT 300)"
)
_IDF = (
    "fit AS (SELECT term, total, df, ln((1.0 + (SELECT count(*) FROM train)) / (1.0 + df)) + 1.0 AS idf FROM vocab)"
)


def tokenized(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return tfidf.tokenize_docs(texts(spark, sf_dir, *columns))


def training_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the training documents: all but hash fold 0."""
    folded = sampling.stratified_folds(texts(spark, sf_dir), "doc_id", "doc_id")
    return tfidf.tokenize_docs(folded.filter("fold <> 0")).select("doc_id", "tokens")


@query(
    "tokenize_docs",
    _with(
        "SELECT doc_id, len(tokens) AS n_tokens, md5(array_to_string(tokens, ' ')) AS digest FROM toks",
        TOKENS_SQL, features=False,
    ),
)
def tokenize_docs(spark, sf_dir):
    return tokenized(spark, sf_dir).select(
        "doc_id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("digest")
    )


@query(
    "vocabulary_top_n",
    _with("SELECT term, total, df FROM vocab", TOKENS_SQL, _TRAIN, _TERMS, _VOCAB, features=False),
)
def vocabulary_top_n(spark, sf_dir):
    return tfidf.vocabulary_top_n(training_tokens(spark, sf_dir))


@query(
    "tfidf_fit",
    _with(
        "SELECT term, total, df, round(idf, 9) AS idf FROM fit",
        TOKENS_SQL, _TRAIN, _TERMS, _VOCAB, _IDF, features=False,
    ),
)
def tfidf_fit(spark, sf_dir):
    return tfidf.tfidf_fit(training_tokens(spark, sf_dir)).withColumn("idf", F.round("idf", 9))


@query(
    "tfidf_transform",
    _with(
        """SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM (
          SELECT doc_id, term, (1.0 + ln(count(*))) * any_value(idf) AS w
          FROM (SELECT doc_id, unnest(tokens) AS term FROM toks) JOIN fit USING (term) GROUP BY doc_id, term)""",
        TOKENS_SQL, _TRAIN, _TERMS, _VOCAB, _IDF, features=False,
    ),
)
def tfidf_transform(spark, sf_dir):
    vocabulary = tfidf.vocabulary_rows(tfidf.tfidf_fit(training_tokens(spark, sf_dir)))
    return tfidf.tfidf_transform(tokenized(spark, sf_dir), vocabulary, "doc_id").withColumn(
        "weight", F.round("weight", 6)
    )


def labelled_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, label, identifier features, tokens) of the labelled documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    docs = identifier_features(texts(spark, sf_dir, "lang").join(labels, "doc_id"))
    return tfidf.tokenize_docs(docs).drop("text")


_ASSEMBLE_SQL = _with(
    f"""SELECT lab.doc_id, label, CAST((SELECT count(*) FROM vocab) + {len(FEATURE_NAMES)} AS INTEGER) AS n_features,
        CAST(coalesce(n, 0) + {" + ".join(f"CASE WHEN {f} <> 0 THEN 1 ELSE 0 END" for f in FEATURE_NAMES)} AS INTEGER) AS n_nonzero,
        round(coalesce(t, 0.0) + {" + ".join(FEATURE_NAMES)}, 6) AS total
        FROM lab LEFT JOIN tw USING (doc_id)""",
    TOKENS_SQL, "train AS (SELECT toks.* FROM toks JOIN labels USING (doc_id))", _TERMS, _VOCAB, _IDF,
    """ww AS (SELECT doc_id, term, (1.0 + ln(count(*))) * any_value(idf) AS w FROM terms JOIN fit USING (term) GROUP BY doc_id, term),
tw AS (SELECT doc_id, count(*) AS n, sum(w) / sqrt(sum(w * w)) AS t FROM ww GROUP BY doc_id)""",
)


@query("assemble_features", _ASSEMBLE_SQL)
def assemble_features(spark, sf_dir):
    """Vector size, non-zero entries and sum per labelled document."""
    from pyspark.ml.functions import vector_to_array

    rows = labelled_tokens(spark, sf_dir)
    vocabulary = tfidf.vocabulary_rows(tfidf.tfidf_fit(rows))
    values = tfidf.assemble_features(rows, vocabulary).select(
        "doc_id", "label", vector_to_array("features").alias("v")
    )
    return values.select(
        "doc_id", "label", F.size("v").alias("n_features"),
        F.size(F.filter("v", lambda x: x != 0)).alias("n_nonzero"),
        F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


# --- rules -----------------------------------------------------------------------------


@query(
    "rule_fire",
    _with(
        "\nUNION ALL ".join(
            f"SELECT doc_id, {i} AS rule_id FROM feat WHERE {_fire_sql(r)}" for i, r in enumerate(POLICY)
        )
    ),
)
def rule_fire(spark, sf_dir):
    return rules.rule_fire(features(spark, sf_dir), POLICY, "doc_id")


_FIRED_SQL = "list_filter([" + ", ".join(
    f"CASE WHEN {_fire_sql(r)} THEN {i} END" for i, r in enumerate(POLICY)
) + "], lambda i: i IS NOT NULL)"


@query(
    "apply_rule_set",
    _with(
        f"SELECT doc_id, {_decide_sql(POLICY)} AS predicted, array_to_string({_FIRED_SQL}, ',') AS fired_rules FROM feat"
    ),
)
def apply_rule_set(spark, sf_dir):
    decided = rules.apply_rule_set(features(spark, sf_dir), POLICY)
    fired = F.array_join(F.transform("fired_rules", lambda i: i.cast("string")), ",")
    return decided.select("doc_id", "predicted", fired.alias("fired_rules"))


@query(
    "flag_confidential_documents",
    _with(
        f"""SELECT lang, count(*) AS n_docs, sum(p) AS n_flagged, sum(CASE WHEN pat_card_valid > 0 THEN 1 ELSE 0 END) AS n_with_card
        FROM (SELECT *, {_decide_sql(POLICY)} AS p FROM feat) GROUP BY lang"""
    ),
)
def flag_confidential_documents(spark, sf_dir):
    """Flagship: identifier features, policy, counts per language in one pass."""
    decided = rules.apply_rule_set(features(spark, sf_dir), POLICY)
    return decided.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("predicted").alias("n_flagged"),
        F.count_if(F.col("pat_card_valid") > 0).alias("n_with_card"),
    )


@query(
    "explain_decisions",
    _with(
        "SELECT doc_id, array_to_string(list_filter(["
        + ", ".join(f"CASE WHEN {_fire_sql(r)} THEN '{rules.describe(r)}' END" for r in POLICY)
        + "], lambda t: t IS NOT NULL), ' | ') AS why FROM feat"
    ),
)
def explain_decisions(spark, sf_dir):
    explained = rules.explain_decisions(features(spark, sf_dir), POLICY, "doc_id")
    return explained.select("doc_id", F.array_join("why", " | ").alias("why"))


def _metrics_sql(source: str, label: str = "label", predicted: str = "predicted") -> str:
    return f"""SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
      CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
      CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1
      FROM (SELECT sum(CASE WHEN {label} = 1 AND {predicted} = 1 THEN 1 ELSE 0 END) AS tp,
        sum(CASE WHEN {label} = 0 AND {predicted} = 1 THEN 1 ELSE 0 END) AS fp,
        sum(CASE WHEN {label} = 1 AND {predicted} = 0 THEN 1 ELSE 0 END) AS fn,
        sum(CASE WHEN {label} = 0 AND {predicted} = 0 THEN 1 ELSE 0 END) AS tn FROM {source})"""


@query(
    "binary_metrics",
    _with(
        "SELECT tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 "
        f"FROM ({_metrics_sql('d')})",
        f"d AS (SELECT label, {_decide_sql(POLICY)} AS predicted FROM lab)",
    ),
)
def binary_metrics(spark, sf_dir):
    decided = rules.apply_rule_set(labelled(spark, sf_dir), POLICY)
    return metrics.binary_metrics(decided, "label", "predicted").select(
        "tp", "fp", "fn", "tn", *r6("precision", "recall", "f1")
    )


@query(
    "alarm_error_rates",
    _with(
        "SELECT round(1.0 - recall, 6) AS fnr, round(fp / greatest(fp + tn, 1), 6) AS fpr "
        f"FROM ({_metrics_sql('d')})",
        f"d AS (SELECT label, {_decide_sql(POLICY)} AS predicted FROM lab)",
    ),
)
def alarm_error_rates(spark, sf_dir):
    decided = rules.apply_rule_set(labelled(spark, sf_dir), POLICY)
    return metrics.alarm_error_rates(decided, "label", "predicted").select(*r6("fnr", "fpr"))


def _patch_row(name: str, ruleset: rules.RuleSet) -> str:
    inner = _metrics_sql(f"(SELECT label, {_decide_sql(ruleset)} AS predicted FROM lab)")
    on_new = (
        f"(SELECT avg({_decide_sql(ruleset)}) FROM lab WHERE label = 1 AND pat_card_like > 0)"
    )
    return f"SELECT '{name}' AS version, round(f1, 6) AS f1, round({on_new}, 6) AS recall_new_kind FROM ({inner})"


@query(
    "patch_rule_set",
    _with(_patch_row("before", POLICY[1:]) + "\nUNION ALL " + _patch_row("patched", POLICY[1:] + [EXPERT_RULE])),
)
def patch_rule_set(spark, sf_dir):
    """F1 before and after one expert rule, and recall on the kind it names."""
    rows = keep_hot(labelled(spark, sf_dir))
    before = rules.rule_table(spark, {0: POLICY[1:]})
    out = []
    for name, stored in (("before", before), ("patched", rules.patch_rule_set(before, 0, EXPERT_RULE))):
        decided = rules.apply_rule_set(rows, rules.rules_from_table(stored)[0])
        counts = metrics.confusion(decided, "label", "predicted")
        new_kind = decided.filter((F.col("label") == 1) & (F.col("pat_card_like") > 0))
        recall = new_kind.agg(F.round(F.avg("predicted"), 6)).scalar()
        out.append(
            metrics.with_scores(counts).select(
                F.lit(name).alias("version"), F.round("f1", 6).alias("f1"), recall.alias("recall_new_kind")
            )
        )
    return out[0].unionByName(out[1])


def candidate_sets(n: int = 40) -> list[rules.RuleSet]:
    """A fixed family of candidate rule sets with one to four rules."""
    sets = []
    for i in range(n):
        base: rules.RuleSet = [[("meta_len", 1, 0.25 * (i % 10))]]
        if i % 2:
            base.append([("pat_person", 1, float(i % 5)), ("meta_digit_ratio", 1, 0.0001 * i)])
        if i % 3 == 0:
            base.append([("kw_sensitive", 1, 0.0), ("meta_len", -1, 2.0 + i)])
        if i % 4 == 0:
            base.append([("pat_card_like", 1, 0.0)])
        sets.append(base[1:] if i % 5 == 0 and len(base) > 1 else base)
    return sets


def _sets_sql() -> str:
    rows = ", ".join(
        f"({s}, {r}, '{f}', {op}, {t!r})"
        for s, ruleset in enumerate(candidate_sets())
        for r, rule in enumerate(ruleset)
        for f, op, t in rule
    )
    costs = ", ".join(
        f"({s}, {0.05 * rules.complexity(ruleset, 8, 3)!r})" for s, ruleset in enumerate(candidate_sets())
    )
    used = sorted({f for ruleset in candidate_sets() for rule in ruleset for f, _, _ in rule})
    values = "\nUNION ALL ".join(f"SELECT doc_id, label, '{f}' AS feature, {f} AS v FROM lab" for f in used)
    return f"""conds(set_id, rule_id, feature, op, thr) AS (VALUES {rows}),
    costs(set_id, cost) AS (VALUES {costs}),
    vals AS ({values}),
    fired AS (SELECT set_id, rule_id, doc_id, label, bool_and(CASE WHEN op > 0 THEN v > thr ELSE v < thr END) AS hit
      FROM conds JOIN vals USING (feature) GROUP BY ALL),
    decided AS (SELECT set_id, doc_id, label, CASE WHEN bool_or(hit) THEN 1 ELSE 0 END AS p FROM fired GROUP BY ALL),
    cnt AS (SELECT set_id, sum(CASE WHEN label = 1 AND p = 1 THEN 1 ELSE 0 END) AS tp,
      sum(CASE WHEN label = 0 AND p = 1 THEN 1 ELSE 0 END) AS fp,
      sum(CASE WHEN label = 1 AND p = 0 THEN 1 ELSE 0 END) AS fn FROM decided GROUP BY set_id)"""


@query(
    "score_rule_sets",
    _with(
        """SELECT set_id, tp, fp, fn, round(f1, 6) AS f1, round(f1 - cost, 6) AS fitness FROM (
          SELECT cnt.*, cost, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1
          FROM cnt JOIN costs USING (set_id))""",
        _sets_sql(),
    ),
)
def score_rule_sets(spark, sf_dir):
    scored = rules.score_rule_sets(labelled(spark, sf_dir), "label", candidate_sets())
    return scored.select("set_id", "tp", "fp", "fn", *r6("f1", "fitness"))


_N_FIRED = " + ".join(f"CAST({_fire_sql(r)} AS INTEGER)" for r in POLICY)


@query(
    "rule_interpretability",
    _with(
        f"""SELECT {len(POLICY)} AS n_rules, {sum(map(len, POLICY)) / len(POLICY)!r} AS avg_conds,
        coalesce(round(avg(CASE WHEN n > 0 THEN CASE WHEN n <= 2 THEN 1.0 ELSE 0.0 END END), 6), 1.0)
          AS share_pos_explained_le2_rules FROM (SELECT {_N_FIRED} AS n FROM feat)"""
    ),
)
def rule_interpretability(spark, sf_dir):
    shown = rules.rule_interpretability(features(spark, sf_dir), POLICY)
    return shown.select("n_rules", "avg_conds", *r6("share_pos_explained_le2_rules"))


_SEPARATION = "sep AS (" + "\nUNION ALL ".join(
    f"SELECT '{f}' AS feature, avg({f}) FILTER (label = 1) AS mean_pos, avg({f}) FILTER (label = 0) AS mean_neg, "
    f"stddev_pop({f}) AS std FROM lab"
    for f in FEATURE_NAMES
) + "),\nranked AS (SELECT *, abs(mean_pos - mean_neg) / (std + 1e-9) AS separation FROM sep)"


@query(
    "feature_separation",
    _with(
        "SELECT feature, round(mean_pos, 6) AS mean_pos, round(mean_neg, 6) AS mean_neg, round(std, 6) AS std, "
        "round(separation, 6) AS separation FROM ranked",
        _SEPARATION,
    ),
)
def feature_separation(spark, sf_dir):
    found = rules.feature_separation(labelled(spark, sf_dir), "label", FEATURE_NAMES)
    return found.select("feature", *r6("mean_pos", "mean_neg", "std", "separation"))


@query(
    "midpoint_rules",
    _with(
        "SELECT feature, CASE WHEN mean_pos > mean_neg THEN 1 ELSE -1 END AS op, "
        "round((mean_pos + mean_neg) / 2, 6) AS thr FROM ranked",
        _SEPARATION,
    ),
)
def midpoint_rules(spark, sf_dir):
    found = rules.feature_separation(labelled(spark, sf_dir), "label", FEATURE_NAMES)
    return rules.midpoint_rules(found).select("feature", "op", *r6("thr"))


def _thresholds_sql() -> str:
    open_pos = f"label = 1 AND NOT {_fire_sql(POLICY[0])}"
    parts = [
        f"SELECT '{f}' AS feature, avg({f}) FILTER ({open_pos}) AS m1, avg({f}) FILTER (label = 0) AS m0, "
        + ", ".join(f"quantile_cont({f}, {q}) FILTER ({open_pos}) AS q{i}" for i, q in enumerate((0.1, 0.25, 0.5)))
        + " FROM lab"
        for f in FEATURE_NAMES
    ]
    return "thr AS (SELECT *, CASE WHEN m1 > m0 THEN 1 ELSE -1 END AS op FROM (" + "\nUNION ALL ".join(parts) + "))"


@query(
    "threshold_candidates",
    _with(
        """SELECT feature, op, 'midpoint' AS kind, round((m1 + m0) / 2, 6) AS thr FROM thr
        UNION ALL SELECT feature, op, 'p10', round(q0 - 1e-9 * op, 6) FROM thr
        UNION ALL SELECT feature, op, 'p25', round(q1 - 1e-9 * op, 6) FROM thr
        UNION ALL SELECT feature, op, 'p50', round(q2 - 1e-9 * op, 6) FROM thr""",
        _thresholds_sql(),
    ),
)
def threshold_candidates(spark, sf_dir):
    """Conditions for the positives that the card rule leaves open."""
    rows = labelled(spark, sf_dir)
    found = rules.threshold_candidates(rows, "label", FEATURE_NAMES, rules.fires(POLICY[0]))
    return found.select("feature", "op", "kind", *r6("thr"))


def _rule_rows(spark: SparkSession, rows: DataFrame, ruleset: rules.RuleSet) -> DataFrame:
    """A found rule set with its text and its quality on the rows it was found on."""
    decided = rules.apply_rule_set(rows, ruleset)
    quality = metrics.binary_metrics(decided, "label", "predicted").first()
    return spark.createDataFrame(
        [(i, rules.describe(r), len(r), float(quality["f1"])) for i, r in enumerate(ruleset)],
        "rule_id int, rule string, n_conds int, f1 double",
    )


def searched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Weights of 300 words and identifier features of the labelled documents, and their names."""
    rows = keep_hot(labelled_tokens(spark, sf_dir))
    wide, words = tfidf.word_columns(rows, tfidf.vocabulary_rows(tfidf.tfidf_fit(rows)))
    return keep_hot(wide, 1_000), [*words, *FEATURE_NAMES]


@query("sequential_covering")
def sequential_covering(spark, sf_dir):
    rows, names = searched(spark, sf_dir)
    return _rule_rows(spark, rows, rule_search.sequential_covering(rows, "label", names))


@query("specialize_rule")
def specialize_rule(spark, sf_dir):
    import numpy as np

    rows, names = searched(spark, sf_dir)
    s = rule_search.SearchSettings()
    stats = rules.class_statistics(rows, "label", names).collect()
    ranked = [r.feature for r in rules.feature_separation(rows, "label", names).collect()]
    proposer = rule_search.Proposer(stats, ranked, s, np.random.default_rng(0))
    return _rule_rows(spark, rows, rule_search.specialize_rule(rows, "label", POLICY, proposer, s))


@query("evolve_rules")
def evolve_rules(spark, sf_dir):
    """The whole search, over words and identifiers: 80 generations and 2 restarts at most."""
    rows, names = searched(spark, sf_dir)
    return _rule_rows(spark, rows, rule_search.evolve_rules(rows, "label", names).rules)


@query("lambda_sensitivity")
def lambda_sensitivity(spark, sf_dir):
    """The whole search, as evolve_rules does it, for every weight and fold; words are learnt per fold."""
    rows = sampling.stratified_folds(labelled_tokens(spark, sf_dir), "label", "doc_id", folds=3)
    found = classifiers.lambda_sensitivity(keep_hot(rows), "label", FEATURE_NAMES)
    return found.groupBy("lam").agg(
        F.avg("f1").alias("f1_mean"), F.stddev_pop("f1").alias("f1_std"), F.avg("n_rules").alias("rules_mean")
    )


# --- comparison --------------------------------------------------------------------------

_FOLD_F1 = _with(
    """SELECT rule_id, round(avg(f1), 6) AS mean, round(stddev_pop(f1), 6) AS std, count(f1) AS n FROM fs GROUP BY rule_id""",
    "pr AS (" + "\nUNION ALL ".join(
        f"SELECT {i} AS rule_id, {fold_sql()} AS fold, label, CASE WHEN {_fire_sql(r)} THEN 1 ELSE 0 END AS p FROM lab"
        for i, r in enumerate(POLICY)
    ) + ")",
    """fs AS (SELECT rule_id, fold, CASE WHEN sum(p) > 0 THEN
        2.0 * sum(p * label) / (sum(p) + sum(label)) END AS f1 FROM pr GROUP BY rule_id, fold)""",
)


@query("fold_mean_std", _FOLD_F1)
def fold_mean_std(spark, sf_dir):
    """F1 of each rule of the policy per fold; folds where it never fires are skipped."""
    rows = sampling.stratified_folds(labelled(spark, sf_dir), "label", "doc_id")
    fired = F.array(*[F.struct(F.lit(i).alias("rule_id"), rules.fires(r).cast("int").alias("p")) for i, r in enumerate(POLICY)])
    long = rows.select("fold", "label", F.explode(fired).alias("r")).select("fold", "label", "r.*")
    counts = metrics.confusion(long, "label", "p", ["rule_id", "fold"])
    f1 = metrics.f1_column(F.col("tp"), F.col("fp"), F.col("fn"))
    scored = counts.withColumn("value", F.when(F.col("tp") + F.col("fp") > 0, f1))
    return metrics.fold_mean_std(scored, ["rule_id"]).select("rule_id", *r6("mean", "std"), "n")


@query("cross_validate_baselines")
def cross_validate_baselines(spark, sf_dir):
    rows = sampling.stratified_folds(labelled_tokens(spark, sf_dir), "label", "doc_id")
    found = classifiers.cross_validate_baselines(keep_hot(rows))
    return found.groupBy("model").agg(
        *[F.avg(m).alias(f"{m}_mean") for m in ("precision", "recall", "f1")], F.stddev_pop("f1").alias("f1_std")
    )


@query("label_budget_curve")
def label_budget_curve(spark, sf_dir):
    """The new kind: documents in other languages than the training ones."""
    rows = keep_hot(labelled_tokens(spark, sf_dir).withColumn("__h", sampling.hash_of(42, "doc_id")))
    foreign = rows.filter(F.col("lang") != "en")
    even = F.conv(F.substring("__h", 32, 1), 16, 10).cast("int") % 2 == 0
    return classifiers.label_budget_curve(
        rows.filter(F.col("lang") == "en").drop("__h"), foreign.filter(even), foreign.filter(~even).drop("__h")
    )


@query(
    "write_results",
    _with(
        """SELECT 'rules' AS experiment, lang AS dataset, 'policy' AS method, m AS metric,
          CAST(CASE WHEN m = 'n_docs' THEN n_docs ELSE n_flagged END AS DOUBLE) AS value
          FROM (SELECT lang, count(*) AS n_docs, sum(p) AS n_flagged FROM
            (SELECT *, %s AS p FROM feat) GROUP BY lang), (VALUES ('n_docs'), ('n_flagged')) t(m)"""
        % _decide_sql(POLICY)
    ),
)
def write_results(spark, sf_dir):
    """Store the flagship counts as a long table, read it back."""
    counts = flag_confidential_documents(spark, sf_dir)
    path = scratch_path(spark, "results")
    long = readers.long_results(counts, "rules", F.col("lang"), F.lit("policy"), ["n_docs", "n_flagged"])
    readers.write_results(long, path)
    return readers.read_results(spark, path)
