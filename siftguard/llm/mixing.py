"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources are cut into blocks of equally many words. The blocks of the whole mix are seats,
dealt to sources by the highest quotients of their targets, then to the shards of a source by
the quotients of their sizes. Each shard fills its integer quota with a seeded choice of its
blocks; a quota beyond its blocks takes all of them and begins again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftguard.llm.words import pieces
from siftguard.session import materialize, spread

WEIGHTS = (3, 1, 2)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch.column(2)):
            part = batch.slice(piece.rows.start, len(piece.rows))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(np.diff(piece.first), pa.int64()), *part.columns[3:]],
                ["doc_id", "source", "size", *part.schema.names[3:]],
            )


def sizes(docs: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """Words of each document; long columns of ``key`` go along."""
    schema = "doc_id long, source string, size long" + "".join(f", `{k}` long" for k in key)
    return spread(docs.select("doc_id", "source", "text", *key)).mapInArrow(_sizes, schema)


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """Target words of every source: source, src (its rank), source_size, target.

    Sources in code point order, null last, weigh ``weights``, repeating, and share ``share``
    of all words. A target stops at ``most`` times its source's size; the excess goes to the
    others by weight until none is above. In closed form: in the order of cap over weight,
    sources are capped as long as the level that the rest would get reaches their cap. One
    row per source: windows over this table are as large as the recipe.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("src") - 1) % len(weights) + 1).cast("int"))
    ranked = per_source.withColumn("src", F.row_number().over(order)).withColumn("weight", weight)
    cap = F.col("source_size") * most
    by_level = Window.orderBy(cap / F.col("weight"), "src")
    above = by_level.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    total = F.sum("source_size").over(all_rows) * share
    # What is left for this and all later sources, over their weights.
    level = (total - (F.sum(cap).over(all_rows) - F.sum(cap).over(above))) / F.sum("weight").over(above)
    leveled = ranked.select("*", cap.alias("cap"), level.alias("level")).withColumn(
        "capped", F.col("cap") / F.col("weight") <= F.col("level")
    )
    common = F.max(F.when(~F.col("capped"), F.col("level"))).over(all_rows)
    return leveled.select(
        "source", "src", "source_size",
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * common).alias("target"),
    )


def apportion(parties: DataFrame, group: list[str], key: str, weight: str, seats: str) -> DataFrame:
    """Sainte-Laguë: ``quota`` of every party, ``seats`` of its group dealt by highest quotients.

    All seats above a safe divisor are dealt at once; of the quotients just below it, at
    most two per party on average, the highest fill up the rest. Ties go to the smaller key.
    """
    whole = Window.partitionBy(*group)
    half = F.count("*").over(whole) / 2
    total = F.sum(weight).over(whole)
    share = F.when(total > 0, F.col(weight) / total).otherwise(F.lit(0.0))
    first = F.floor(share * F.greatest(F.col(seats) - half, F.lit(0.0)) + 0.5)
    upper = F.floor(share * (F.col(seats) + half) + 0.5) + 1
    dealt = parties.select("*", F.when(share > 0, first).otherwise(0).alias("__first"), upper.alias("__upper")).withColumn(
        "__rest", F.col(seats) - F.sum("__first").over(whole)
    )
    best = Window.partitionBy(*group).orderBy(F.desc("__quotient"), key)
    more = (
        dealt.filter(F.col(weight) > 0).select(*group, key, weight, "__rest", F.explode(F.sequence("__first", "__upper")).alias("__seat"))
        .filter("__seat > 0").join(dealt.select(*group, key, F.col("__first").alias("__had")), [*group, key])
        .filter("__seat > __had").withColumn("__quotient", F.col(weight) / (2 * F.col("__seat") - 1))
        .withColumn("__place", F.row_number().over(best)).filter("__place <= __rest")
        .groupBy(*group, key).agg(F.count("*").alias("__more"))
    )
    return dealt.join(more, [*group, key], "left").withColumn(
        "quota", F.col("__first") + F.coalesce("__more", F.lit(0))
    ).drop("__first", "__upper", "__rest", "__more")


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2,
    block_words: int = 128, shard_words: int = 1_000_000, seed: str = "mix", key: tuple[str, ...] = (),
) -> DataFrame:
    """Words that the mix takes of every document.

    Returns, per input row, doc_id, size (words; null text: 0), source_size, target (of its
    source) and taken (repeats counted, at most ``most`` times the size). Documents of a
    source stand in a seeded order in shards of about ``shard_words``; the words of a shard
    are cut into blocks of ``block_words``, the last one shorter. A null source is a source.
    Documents without words take nothing. Repeated rows and ids are documents of their own;
    equal rows may swap what they take. Other columns are ignored. Long columns named in
    ``key`` are returned as well.
    """
    sized = materialize(sizes(docs, key), "mix-sizes")
    goals = materialize(targets(sized, weights, share, most), "mix-targets")
    name = goals.withColumnRenamed("source", "of")
    joined = sized.join(name, F.col("source").eqNullSafe(F.col("of"))).drop("of", "source")
    lot = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    shards = F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1))
    placed = joined.withColumn("__lot", lot).withColumn(
        "shard", F.conv(F.substring("__lot", 1, 8), 16, 10).cast("long") % shards
    )
    along = Window.partitionBy("src", "shard").orderBy("__lot", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = materialize(
        placed.withColumn("start", F.coalesce(F.sum("size").over(along), F.lit(0).cast("long"))).drop("__lot"), "mix-shards"
    )

    seats = goals.withColumn("all", F.lit(0)).withColumn(
        "seats", F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long")
    )
    per_source = apportion(seats, ["all"], "src", "target", "seats").select("src", F.col("quota").alias("source_quota"))
    per_shard = placed.groupBy("src", "shard").agg(F.sum("size").alias("words")).filter("words > 0").join(per_source, "src")
    quotas = apportion(per_shard, ["src"], "shard", "words", "source_quota")
    blocks = F.ceil(F.col("words") / block_words)
    quotas = materialize(quotas.select(
        "src", "shard", "words", blocks.alias("blocks"), F.least("quota", blocks * most).alias("quota")
    ), "mix-quotas")

    # Seeded choice: whole rounds take every block, the rest of the quota the lowest hashes.
    dealt = quotas.select("src", "shard", "blocks", "quota", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    lot = F.md5(F.concat_ws(":", F.lit(seed), F.col("src"), F.col("shard"), F.col("block")))
    drawn = dealt.withColumn("__n", F.row_number().over(Window.partitionBy("src", "shard").orderBy(lot, "block")))
    chosen = drawn.filter(F.col("__n") <= F.col("quota") % F.col("blocks")).select("src", "shard", "block", F.lit(1).alias("drawn"))

    end = F.col("start") + F.col("size")
    touched = placed.filter("size > 0").select(
        "src", "shard", "start", "size",
        F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))).alias("block"),
    )
    overlap = F.least(end, (F.col("block") + 1) * block_words) - F.greatest(F.col("start"), F.col("block") * block_words)
    parts = touched.join(chosen.hint("merge"), ["src", "shard", "block"]).groupBy("src", "shard", "start").agg(F.sum(overlap).alias("part"))
    rounds = quotas.select("src", "shard", F.floor(F.col("quota") / F.col("blocks")).alias("rounds"))
    sums = (
        placed.filter("size > 0").join(rounds, ["src", "shard"]).join(parts.hint("merge"), ["src", "shard", "start"], "left")
        .withColumn("taken", F.col("rounds") * F.col("size") + F.coalesce("part", F.lit(0).cast("long")))
    )
    columns = ["doc_id", "size", "source_size", "target", "taken", *key]
    none = placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return sums.select(columns).union(none.select(columns))
