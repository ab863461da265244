"""IF-THEN rule policies over wide feature tables.

A rule is a conjunction of conditions (feature, op, threshold) with op +1 for ``>``
and -1 for ``<``; a rule set is positive if any rule fires. Rule tables are kilobytes
and live on the driver; documents never do.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftguard.operators.bitmaps import BitmapIndex, build_index, class_parts, open_pairs
from siftguard.operators.columns import Counted, column_pairs, quantiles, sketch
from siftguard.operators.metrics import f1_column

Condition = tuple[str, int, float]
Rule = list[Condition]
RuleSet = list[Rule]

# Above this many candidate sets, scoring switches from generated expressions to
# Arrow batches, as huge projections fall out of code generation.
EXPRESSION_LIMIT = 16

RULE_SCHEMA = "set_id int, rule_id int, cond_id int, feature string, op int, thr double"


def fires(rule: Rule) -> Column:
    """AND of strict comparisons; a rule without conditions always fires.

    A missing value, NULL or NaN, meets no condition.
    """
    parts = [
        (F.col(f) > F.lit(float(t))) & ~F.isnan(f) if op > 0 else F.col(f) < F.lit(float(t)) for f, op, t in rule
    ]
    return F.coalesce(reduce(lambda a, b: a & b, parts, F.lit(True)), F.lit(False))


def decides(rules: RuleSet) -> Column:
    """OR of the rules; an empty set never decides positive."""
    return reduce(lambda a, b: a | b, [fires(r) for r in rules], F.lit(False))


def describe(rule: Rule) -> str:
    """Readable text, thresholds with three significant digits."""
    body = " AND ".join(f"{f} {'>' if op > 0 else '<'} {t:.3g}" for f, op, t in rule)
    return f"IF {body} THEN confidential"


def rule_fire(df: DataFrame, rules: RuleSet, row_id: str) -> DataFrame:
    """Long form: one row per (document, fired rule)."""
    hits = F.array(*[F.when(fires(r), F.lit(i)) for i, r in enumerate(rules)])
    return df.select(row_id, F.explode(F.filter(hits, lambda i: i.isNotNull())).alias("rule_id"))


def apply_rule_set(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Add the decision and the ids of the fired rules."""
    hits = F.array(*[F.when(fires(r), F.lit(i)) for i, r in enumerate(rules)])
    return df.withColumn("predicted", decides(rules).cast("int")).withColumn(
        "fired_rules", F.filter(hits, lambda i: i.isNotNull())
    )


def explain_decisions(df: DataFrame, rules: RuleSet, row_id: str) -> DataFrame:
    """Per document, the fired rules as text in rule order."""
    texts = F.array(*[F.when(fires(r), F.lit(describe(r))) for r in rules])
    return df.select(row_id, F.filter(texts, lambda t: t.isNotNull()).alias("why"))


def rule_table(spark: SparkSession, sets: dict[int, RuleSet]) -> DataFrame:
    """Rule sets as rows, for storing and exchange."""
    rows = [
        (s, i, j, f, op, float(t))
        for s, rules in sets.items()
        for i, rule in enumerate(rules)
        for j, (f, op, t) in enumerate(rule)
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def rules_from_table(table: DataFrame) -> dict[int, RuleSet]:
    """The inverse; rule tables are small by nature."""
    sets: dict[int, dict[int, Rule]] = {}
    for r in table.orderBy("set_id", "rule_id", "cond_id").collect():
        sets.setdefault(r.set_id, {}).setdefault(r.rule_id, []).append((r.feature, r.op, r.thr))
    return {s: list(rules.values()) for s, rules in sets.items()}


def patch_rule_set(table: DataFrame, set_id: int, rule: Rule) -> DataFrame:
    """Append one expert rule to a stored set; nothing is refitted."""
    spark = table.sparkSession
    next_id = table.filter(F.col("set_id") == set_id).agg(F.coalesce(F.max("rule_id") + 1, F.lit(0)))
    added = rule_table(spark, {set_id: [rule]}).withColumn("rule_id", next_id.scalar().cast("int"))
    return table.unionByName(added.select(*table.columns))


def complexity(rules: RuleSet, max_rules: int, max_conds: int) -> float:
    conds = sum(len(r) for r in rules)
    return 0.5 * len(rules) / max_rules + 0.5 * conds / (max_rules * max_conds)


def _counts_by_expression(df: DataFrame, label: str, sets: list[RuleSet]) -> DataFrame:
    y = F.col(label) == 1
    aggs = []
    for i, rules in enumerate(sets):
        hit = decides(rules)
        aggs += [F.count_if(hit & y).alias(f"tp{i}"), F.count_if(hit & ~y).alias(f"fp{i}")]
    one = df.agg(F.count_if(y).alias("pos"), *aggs)
    return one.select(
        "pos",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("set_id"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"))
                    for i in range(len(sets))
                ]
            )
        ).alias("c"),
    ).select("c.set_id", "c.tp", "c.fp", (F.col("pos") - F.col("c.tp")).alias("fn"))


def _counts_by_batch(df: DataFrame, label: str, sets: list[RuleSet]) -> DataFrame:
    names = sorted({f for rules in sets for rule in rules for f, _, _ in rule})
    # Equal conditions and rules are evaluated once per batch.
    conditions = sorted({c for rules in sets for rule in rules for c in rule})
    index = {c: i for i, c in enumerate(conditions)}
    rule_keys = sorted({tuple(sorted(index[c] for c in rule)) for rules in sets for rule in rules})
    rule_index = {k: i for i, k in enumerate(rule_keys)}
    members = [[rule_index[tuple(sorted(index[c] for c in rule))] for rule in rules] for rules in sets]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tp = np.zeros(len(sets), dtype=np.int64)
        fp = np.zeros(len(sets), dtype=np.int64)
        fn = np.zeros(len(sets), dtype=np.int64)
        for batch in batches:
            y = batch.column(label).to_numpy(zero_copy_only=False) == 1
            columns = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
            held = [columns[f] > t if op > 0 else columns[f] < t for f, op, t in conditions]
            fired = [
                np.logical_and.reduce([held[c] for c in key]) if key else np.ones(len(y), dtype=bool)
                for key in rule_keys
            ]
            positives = int(y.sum())
            for s, rule_ids in enumerate(members):
                if rule_ids:
                    hit = np.logical_or.reduce([fired[r] for r in rule_ids])
                    both = int((hit & y).sum())
                    tp[s] += both
                    fp[s] += int(hit.sum()) - both
                    fn[s] += positives - both
                else:
                    fn[s] += positives
        yield pa.RecordBatch.from_pydict(
            {"set_id": np.arange(len(sets), dtype=np.int32), "tp": tp, "fp": fp, "fn": fn}
        )

    partial = df.select(label, *names).mapInArrow(count, "set_id int, tp long, fp long, fn long")
    return partial.groupBy("set_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def score_rule_sets(
    df: DataFrame,
    label: str,
    sets: list[RuleSet],
    lam: float = 0.05,
    max_rules: int = 8,
    max_conds: int = 3,
) -> DataFrame:
    """Fitness ``F1 - lam * complexity`` of many candidate sets in one pass.

    Each task keeps three counters per candidate; only these are shuffled. Rows without a
    label are left out; a missing feature meets no condition.
    """
    df = df.filter(F.col(label).isNotNull())
    counter = _counts_by_expression if len(sets) <= EXPRESSION_LIMIT else _counts_by_batch
    costs = [lam * complexity(r, max_rules, max_conds) for r in sets]
    penalty = F.element_at(F.array(*[F.lit(float(c)) for c in costs]), F.col("set_id") + 1)
    counts = counter(df, label, sets)
    f1 = f1_column(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.withColumn("f1", f1).withColumn("fitness", F.col("f1") - penalty)


def rule_interpretability(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Rules, conditions per rule, and share of positives explained by at most two rules."""
    fired = reduce(lambda a, b: a + b, [fires(r).cast("int") for r in rules], F.lit(0))
    share = F.avg(F.when(F.col("n") > 0, (F.col("n") <= 2).cast("double")))
    return df.select(fired.alias("n")).agg(
        F.lit(len(rules)).alias("n_rules"),
        F.lit(sum(len(r) for r in rules) / max(len(rules), 1)).alias("avg_conds"),
        F.coalesce(share, F.lit(1.0)).alias("share_pos_explained_le2_rules"),
    )


STATISTICS = (
    "feature string, mean_pos double, mean_neg double, std double, median double, lowest double, highest double"
)


def class_statistics(df: DataFrame, label: str, features: list[str], medians: bool = True) -> DataFrame:
    """Per feature: class means, deviation, median (the lower one) and range, in order of the list.

    Aggregates over the pairs of the values that are not zero; the median by a sketch and
    an exact second pass. NULL values and, for the class means, rows without a label do not count.
    """
    y = F.col(label)
    n, n_pos, n_neg = df.agg(F.count("*"), F.count_if(y == 1), F.count_if(y == 0)).first()
    pairs = column_pairs(df, features, y.alias("y"))
    y, v = F.col("y"), F.col("v")
    parts = pairs.groupBy("f").agg(
        F.count("v").alias("pairs"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.struct(F.sum(F.when(y == 1, v)).alias("pos"), F.sum(F.when(y == 0, v)).alias("neg")).alias("sums"),
        F.struct(F.count_if((y == 1) & v.isNull()).alias("pos"), F.count_if((y == 0) & v.isNull()).alias("neg"), F.count_if(v.isNull()).alias("all")).alias("nulls"),
        F.count_if(v < 0).alias("below"), *([sketch(v).alias("grid")] if medians else []),
    )
    # One row per column.
    seen = {r["f"]: r for r in parts.collect()}
    rows, counted = [], []
    for f, name in enumerate(features):
        r = seen.get(f)
        pairs_n, nulls = (r["pairs"], r["nulls"]) if r else (0, {"pos": 0, "neg": 0, "all": 0})
        zeros = n - pairs_n - nulls["all"]
        sums = {side: (r["sums"][side] or 0.0) if r else 0.0 for side in ("pos", "neg")}
        mean, var = ((r["mean"] or 0.0), (r["var"] or 0.0)) if r else (0.0, 0.0)
        whole = pairs_n + zeros
        spread = var * pairs_n + mean * mean * pairs_n * zeros / whole if whole else None
        ends = [x for x in ((r["lo"], r["hi"]) if r else ()) if x is not None] + ([0.0] if zeros else [])
        known = lambda total, side, of: total / (of - nulls[side]) if of > nulls[side] else None  # noqa: E731, B023
        nan = any(x != x for x in ends)
        rows.append([
            name, known(sums["pos"], "pos", n_pos), known(sums["neg"], "neg", n_neg),
            None if spread is None else (spread / whole) ** 0.5, None,
            min((x for x in ends if x == x), default=float("nan") if nan else None), float("nan") if nan else max(ends, default=None),
        ])
        counted.append(Counted(f, pairs_n, r["below"] if r else 0, zeros, r["grid"] if r and medians else None))
    if medians:
        for f, cuts in quantiles(pairs.filter("v is not null").select("f", "v"), counted, [0.5], lower=True).items():
            rows[f][4] = cuts[0]
    return df.sparkSession.createDataFrame(rows, STATISTICS)


def feature_separation(df: DataFrame, label: str, features: list[str], top: int = 30) -> DataFrame:
    """Distance of the class means in deviations, largest first."""
    stats = class_statistics(df, label, features, medians=False)
    distance = F.abs(F.col("mean_pos") - F.col("mean_neg")) / (F.col("std") + F.lit(1e-9))
    return (
        stats.withColumn("separation", distance)
        .orderBy(F.desc("separation"), F.asc("feature"))
        .limit(top)
        .select("feature", "mean_pos", "mean_neg", "std", "separation")
    )


def midpoint_rules(separation: DataFrame) -> DataFrame:
    """One condition per feature: threshold half way between the class means."""
    return separation.select(
        "feature",
        F.when(F.col("mean_pos") > F.col("mean_neg"), 1).otherwise(-1).alias("op"),
        ((F.col("mean_pos") + F.col("mean_neg")) / 2).alias("thr"),
    )


THRESHOLDS = "feature string, op int, kind string, thr double, open_positives long"
POINTS = {"p10": 0.1, "p25": 0.25, "p50": 0.5}


def index_thresholds(index: BitmapIndex, covered: RuleSet | None = None) -> list[tuple]:
    """Rows of ``threshold_candidates`` from a bitmap index, in two jobs."""
    parts, n_open, n_neg = class_parts(index, covered or [])
    counted, means = [], []
    for f in range(len(index.features)):
        r = parts.get(f)
        seen1, seen0 = n_open - (r["no1"] if r else 0), n_neg - (r["no0"] if r else 0)
        pairs = r["pairs"] if r else 0
        counted.append(Counted(f, pairs, r["below"] if r else 0, seen1 - pairs, r["grid"] if r else None))
        means.append([(x or 0.0) / seen if seen else None for x, seen in ((r["s1"] if r else 0.0, seen1), (r["s0"] if r else 0.0, seen0))])
    cuts = quantiles(open_pairs(index, covered or []), counted, list(POINTS.values()))
    rows = []
    for f, (m1, m0) in enumerate(means):
        op = 1 if m1 is not None and m0 is not None and m1 > m0 else -1
        middle = None if m1 is None or m0 is None else (m1 + m0) / 2
        rows.append((index.features[f], op, "midpoint", middle, n_open))
        for kind, cut in zip(POINTS, cuts.get(f, [None] * len(POINTS))):
            rows.append((index.features[f], op, kind, None if cut is None else cut - 1e-9 * op, n_open))
    return rows


def threshold_candidates(df: DataFrame, label: str, features: list[str], covered: Column | None = None) -> DataFrame:
    """Conditions to try on positives that no rule covers yet.

    Per feature: the midpoint of uncovered positives and negatives, and the 10th,
    25th and 50th percentile of the uncovered positives, moved by 1e-9 so that
    the strict comparison keeps the percentile itself. Percentiles are exact and
    interpolated. All of it are aggregates over the pairs of the values that are not zero.
    """
    y = F.col(label)
    open_pos = F.coalesce((y == 1) & ~(covered if covered is not None else F.lit(False)), F.lit(False))
    marked = df.select(*features, open_pos.cast("int").alias("__open"), y.alias("__y")).filter("__open = 1 or __y = 0")
    found = index_thresholds(build_index(marked, "__open", features))
    return df.sparkSession.createDataFrame(found, THRESHOLDS)
