"""The operators against plain loops, on rows with nulls, empty and long texts, copies and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from siftguard.llm.decontaminate import find_benchmark
from siftguard.llm.host_quality import judge
from siftguard.llm.jaccard import ngram_jaccard
from siftguard.llm.licenses import NOTICES, bigrams, scan_licenses
from siftguard.llm.lines import drop_common_lines
from siftguard.llm.mixing import mix_sources, sizes, targets
from siftguard.llm.quality_classifier import score_quality
from siftguard.llm.sharding import Ring, capacities, shard_rows
from siftguard.llm.substrings import remove_repeats
from siftguard.llm.toxicity import score_toxicity
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use inside.
CLASHES = ("rep", "token", "gid", "size", "host", "shard", "rank", "label", "hash", "anchor", "items", "features", "gone")


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeßé", k=rng.randint(2, 9))) for _ in range(400)]
    speak = lambda k: " ".join(rng.choices(vocabulary, k=k))
    passage, line = speak(60), speak(8) + " of a common line"
    rows = []
    for i in range(n):
        text = "\n".join(speak(rng.randint(5, 60)) for _ in range(rng.randint(1, 5)))
        kind = i % 8
        if kind == 1:
            text = f"{text}\n{passage}\n{speak(9)}"
        elif kind == 2:
            text = f"  {line.upper()}\t\n{text}\n{line}"
        elif kind == 3 and rows:
            text = rng.choice(rows)[1] or ""
        elif kind == 4 and rows:
            w = (rng.choice(rows)[1] or "x").split(" ")
            w[rng.randrange(len(w))] = speak(1)
            text = " ".join(w)
        elif kind == 5:
            text = rng.choice([None, "", " \n\t", "one", "two words", speak(3), "Shti " * 60, "$$$ ### " * 40])
        rows.append((i * 3 + 1, text, "en", rng.choice(["a", "b", "c", "é", None]), len(text or "")))
    rows.append((5000, speak(60_000), "en", "a", 0))
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return df.withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def found(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def same(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


# --- n-gram Jaccard join


def test_jaccard(rows, docs):
    same(found(ngram_jaccard(docs)), brute.jaccard([r[:2] for r in rows]))


def test_jaccard_in_small_blocks(rows, docs):
    got = found(ngram_jaccard(docs, n=5, num=80, block_tokens=50))
    same(got, brute.jaccard([r[:2] for r in rows], 5, 80, 100))


def test_jaccard_of_a_chain_of_near_copies(spark):
    rng = random.Random(3)
    w = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(w)
        w[rng.randrange(60)] = f"n{i}"
        rows.append((i, " ".join(w)))
    got = found(ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string"), block_tokens=2_000))
    same(got, brute.jaccard(rows))


def test_jaccard_edges(spark, nothing):
    assert found(ngram_jaccard(nothing)) == []
    rows = [(1, "a b"), (1, "a b"), (2, "A  b"), (3, None), (4, ""), (None, "a b")]
    got = found(ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string")))
    same(got, [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4), (None, 1, None)])


def families(seed, n, length=80):
    """Families of near copies, a passage that very many other texts share, and templates filled in."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    passage, template = [[word() for _ in range(length // 2)] for _ in range(2)]
    rows = []
    for f in range(n // 20):
        base = [word() for _ in range(rng.randrange(20, length))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    for _ in range(n // 4):
        rows.append((len(rows), " ".join([word() for _ in range(length // 2)] + passage)))
        rows.append((len(rows), " ".join(template + [word() for _ in range(rng.randrange(2, 12))])))
    return rows


@pytest.mark.parametrize(("n", "num", "block", "grams"), [(4, 85, 10**6, 10**6), (5, 80, 600, 300), (1, 60, 10**6, 50)])
def test_jaccard_of_families(spark, n, num, block, grams):
    rows = families(num, 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    same(found(ngram_jaccard(docs, n=n, num=num, block_tokens=block, task_grams=grams)), brute.jaccard(rows, n, num, 100))


# --- licences


def test_licenses(spark, rows):
    texts = [
        "Released under the MIT License.", "released under the mit license!!", "Released yesterday under the MIT license.",
        "x\nLicensed under CC BY-NC 4.0.\ny", "License", "", None, "Licensed under the Apache License, Version 2.0, by us all",
        "All rights reserved", *[t for v in NOTICES.values() for t in v],
    ]
    docs = [(i, t) for i, t in enumerate(texts)] + [r[:2] for r in rows[:20]]
    want = []
    for i, text in docs:
        for at, line in enumerate((text or "").split("\n"), 1):
            grams = set(bigrams(line))
            for name, notices in NOTICES.items():
                for k, notice in enumerate(notices):
                    other = set(bigrams(notice))
                    if grams and 10 * len(grams & other) >= 4 * (len(grams) + len(other)):
                        want.append((i, at, name, k, len(grams), len(grams & other)))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("line", F.lit(1)).withColumn("t", F.lit(1))
    same(found(scan_licenses(df), "doc_id", "line", "license", "notice", "n_bigrams", "n_shared"), want)
    assert len(want) > 15


def test_licenses_of_nothing(nothing):
    assert found(scan_licenses(nothing)) == []


# --- quality rules


def test_quality(rows, docs):
    same(found(judge(docs)), brute.host_verdicts([(r[0], r[3], r[1]) for r in rows]))


def test_bad_hosts_are_blocked_and_small_ones_shrunk(spark):
    good, bad = "\n".join(f"word{i} is number{i} here" for i in range(30)), "no"
    rows = [(i, good if i % 10 else bad, "", "fine", 0) for i in range(200)]
    rows += [(1000 + i, bad if i % 10 else good, "", "junk", 0) for i in range(200)]
    rows += [(2000, good, "", "tiny", 0), (2001, good, "", "tiny", 0)]
    kept = {r["doc_id"] for r in judge(spark.createDataFrame(rows, SCHEMA)).filter("kept").collect()}
    assert all((i in kept) == bool(i % 10) for i in range(200))
    assert not kept & set(range(1000, 1200))
    assert {2000, 2001} <= kept


def test_quality_of_nothing(nothing):
    assert found(judge(nothing)) == []


# --- mixing


def test_mixing(rows, docs):
    want = brute.mix([(r[0], r[3], r[1]) for r in rows])
    got = [(a, b, c, round(d, 6), e) for a, b, c, d, e in found(mix_sources(docs))]
    same(got, want)


def test_mixing_in_small_shards(rows, docs):
    want = brute.mix([(r[0], r[3], r[1]) for r in rows], block=16, shard_words=700)
    got = [(a, b, c, round(d, 6), e) for a, b, c, d, e in found(mix_sources(docs, block_words=16, shard_words=700))]
    same(got, want)
    assert all(0 <= taken <= 2 * size for _, size, _, _, taken in got)


def test_targets_add_up(docs):
    goals = targets(sizes(docs)).collect()
    assert sum(r["target"] for r in goals) == pytest.approx(1.5 * sum(r["source_size"] for r in goals))
    assert all(r["target"] <= 2 * r["source_size"] for r in goals)


def test_mixing_edges(spark, nothing):
    assert found(mix_sources(nothing)) == []
    empty = spark.createDataFrame([(1, None, "", None, 0), (2, "", "", "a", 0)], SCHEMA)
    same(found(mix_sources(empty)), [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)])


# --- lines, substrings, benchmark


def test_lines(rows, docs):
    columns = ("doc_id", "n_lines", "n_dropped", "kept_sha256")
    want = brute.lines([r[:2] for r in rows])
    same(found(drop_common_lines(docs), *columns), want)
    same(found(drop_common_lines(docs, shard_keys=3), *columns), want)
    assert sum(r[2] for r in want) > 10


def test_lines_edges(spark, nothing):
    assert found(drop_common_lines(nothing)) == []
    line = "a line that is long enough"
    rows = [(1, line), (2, line + "\n" + line), (3, f" {line.upper()}\r\nx"), (None, line), (4, None)]
    got = found(drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_lines", "n_dropped", "kept")
    same(got, [(1, 1, 1, ""), (2, 2, 2, ""), (3, 2, 0, None), (None, 1, 0, None), (4, 1, 0, None)])


def test_lines_count_documents_not_rows(spark):
    """Rows that repeat a document do not make its line one of three documents."""
    line = "a line that is long enough"
    two = [(1, line), (1, line), (1, line), (2, line)]
    got = found(drop_common_lines(spark.createDataFrame(two, "doc_id long, text string")), "doc_id", "n_dropped")
    same(got, [(1, 0), (1, 0), (1, 0), (2, 0)])
    three = [*two, (3, line), (3, line)]
    got = found(drop_common_lines(spark.createDataFrame(three, "doc_id long, text string")), "doc_id", "n_dropped")
    same(got, [(1, 1), (1, 1), (1, 1), (2, 1), (3, 0), (3, 0)])


@pytest.mark.parametrize("width", [50, 7, 1])
def test_substrings(rows, docs, width):
    want = brute.substrings([r[:2] for r in rows], width)
    same(found(remove_repeats(docs, width)[0]), want)
    assert sum(r[2] for r in want) > 100


def test_substrings_edges(spark, nothing):
    assert found(remove_repeats(nothing)[0]) == []
    text = " ".join(map(str, range(60)))
    rows = [(1, text), (2, text), (2, text), (None, text), (3, None)]
    got = found(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))[0])
    full, none = brute.sha(text), brute.sha("")
    same(got, [(1, 60, 0, full), (2, 60, 60, none), (2, 60, 60, none), (None, 60, 0, full), (3, 0, 0, none)])


def test_benchmark(spark, rows, docs):
    rng = random.Random(5)
    texts = [r[1] for r in rows if r[1] and len(r[1].split()) > 30]
    items = [(k, " ".join(rng.choice(texts).split()[5:5 + rng.choice([1, 3, 9, 10, 14, 25])])) for k in range(12)]
    items += [(12, None), (13, "..."), (None, texts[0]), (1, texts[1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("hits", F.lit(1))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = brute.benchmark([r[:2] for r in rows], items)
    same(found(find_benchmark(docs, bench), *columns), want)
    same(found(find_benchmark(docs, bench, block_bytes=200), *columns), want)
    assert sum(r[5] for r in want) > 10


def test_benchmark_edges(spark, nothing, docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert found(find_benchmark(nothing, empty)) == []
    assert found(find_benchmark(docs.limit(5), empty).filter("contaminated")) == []


# --- sharding


def test_shards_follow_the_ring(spark, rows, docs):
    got = {r["doc_id"]: r for r in shard_rows(docs, shards=7, cells=64).collect()}
    ring = Ring(7, cells=64)
    keyed = docs.select("doc_id", F.xxhash64("doc_id").alias("k")).collect()
    used, room = [0] * 7, capacities(len(rows), 7)
    place = {cell: n for n, cell in enumerate(ring.order)}
    order = sorted(keyed, key=lambda r: (place[r["k"] % 64], r["k"], r["doc_id"]))
    for r in order:
        shard = next(s for s in ring.walk(r["k"] % 64) if used[s] < room[s])
        assert (got[r["doc_id"]]["shard"], got[r["doc_id"]]["slot"]) == (shard, used[shard])
        used[shard] += 1
    assert max(used) - min(used) <= 1


def test_bounded_loads_move_few_rows(spark):
    docs = spark.range(8000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    a = {r["doc_id"]: r["shard"] for r in shard_rows(docs, shards=20, slack=0.25).collect()}
    b = {r["doc_id"]: r["shard"] for r in shard_rows(docs, shards=21, slack=0.25).collect()}
    assert max(map(list(a.values()).count, range(20))) <= 500
    assert sum(a[i] != b[i] for i in a) < 0.25 * len(a)


def test_shards_edges(spark, nothing):
    assert found(shard_rows(nothing)) == []
    rows = [(None, "a"), (None, "b"), (1, None), (1, None), (2, "é")]
    got = shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), shards=2).collect()
    assert sorted(r["size"] for r in got) == [16, 16, 17, 17, 18]
    assert sorted((r["shard"], r["slot"]) for r in got) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]


# --- models


def auc(rows, label):
    pos = [r["score"] for r in rows if r[label] == 1]
    neg = [r["score"] for r in rows if r[label] == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("score, label, least", [(score_toxicity, "toxic", 0.8), (score_quality, "quality", 0.95)])
def test_models_on_held_out_rows(spark, score, label, least):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, labels).cache()
    assert scored.count() == docs.count()
    assert scored.filter("score is null or score < 0 or score > 1").count() == 0
    assert auc(scored.filter("held_out").join(labels, "doc_id").collect(), label) >= least


@pytest.mark.parametrize("score, label", [(score_toxicity, "toxic"), (score_quality, "quality")])
def test_models_edges(spark, nothing, docs, rows, score, label):
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    assert score(nothing, none).collect() == []
    flat = score(docs, none).collect()
    assert len(flat) == len(rows) and len({r["score"] for r in flat}) == 1
    odd = spark.createDataFrame([(r[0], i % 2) for i, r in enumerate(rows)] + [(None, 1), (1, None)], f"doc_id long, {label} int")
    few = score(docs.union(docs.limit(1)), odd).collect()
    assert len(few) == len(rows) + 1 and all(0 <= r["score"] <= 1 for r in few)
