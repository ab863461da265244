import numpy as np
import pytest
from pyspark.sql import functions as F

from siftguard.operators.running import hash_rank, quantile_bucket, running, stream_positions, trailing_mean


@pytest.fixture(scope="module")
def skewed(spark):
    """Key a holds most rows; ids have gaps."""
    rng = np.random.default_rng(0)
    ids = np.sort(rng.choice(5000, 900, replace=False)).tolist()
    rows = [(i, "a" if j % 10 else "b", int(rng.integers(0, 5))) for j, i in enumerate(ids)]
    return rows, spark.createDataFrame(rows, "id long, key string, v int")


def by_key(rows):
    out = {}
    for i, k, v in rows:
        out.setdefault(k, []).append((i, v))
    return out


@pytest.mark.parametrize("width", [7, 100, 100_000])
def test_running_sum_and_max(skewed, width):
    rows, df = skewed
    peak = F.when(F.col("v") == 4, F.col("id"))
    found = running(
        df, ["key"], F.floor(F.col("id") / width), ["id"], {"s": ("sum", F.col("v")), "m": ("max", peak)}
    )
    got = {(r.key, r.id): (r.s, r.m) for r in found.collect()}
    for key, items in by_key(rows).items():
        total, last = 0, None
        for i, v in items:
            total, last = total + v, i if v == 4 else last
            assert got[key, i] == (total, last)


@pytest.mark.parametrize("width", [3, 64, 10_000])
def test_positions(skewed, width):
    rows, df = skewed
    got = {(r.key, r.id): r.pos for r in stream_positions(df, "key", "id", width).collect()}
    for key, items in by_key(rows).items():
        assert [got[key, i] for i, _ in items] == list(range(len(items)))


def test_hash_rank(skewed):
    rows, df = skewed
    hashed = df.withColumn("h", F.md5(F.col("id").cast("string")))
    got = hash_rank(hashed, ["key"], "h", prefix=1).collect()
    for key in ("a", "b"):
        mine = sorted((r.h, r["rank"]) for r in got if r.key == key)
        assert [rank for _, rank in mine] == list(range(1, len(mine) + 1))


@pytest.mark.parametrize("window,block", [(1, 10), (5, 5), (20, 8), (50, 1000)])
def test_trailing_mean(skewed, window, block):
    rows, df = skewed
    placed = stream_positions(df, "key", "id")
    got = {(r.key, r.id): r.a for r in trailing_mean(placed, ["key"], "pos", "v", window, "a", block).collect()}
    for key, items in by_key(rows).items():
        values = [v for _, v in items]
        for p, (i, _) in enumerate(items):
            assert abs(got[key, i] - np.mean(values[max(0, p - window + 1): p + 1])) < 1e-12
    assert len(got) == len(rows)


@pytest.mark.parametrize("rows_per_bucket,least", [(100, 8), (4, 200)])
def test_quantile_bucket_follows_the_order(spark, rows_per_bucket, least):
    df = spark.range(997).select((F.col("id") * 37 % 997).cast("double").alias("x"))
    bucket = quantile_bucket(df, "x", rows_per_bucket)
    got = [r.b for r in df.select("x", bucket.alias("b")).orderBy("x").collect()]
    assert got == sorted(got)
    assert len(set(got)) >= least
    assert max(got.count(b) for b in set(got)) <= 4 * max(rows_per_bucket, 997 / 8)


def test_ties_settle_repeated_ids(spark):
    rng = np.random.default_rng(1)
    rows = [("s", int(i), int(v)) for i, v in zip(rng.integers(0, 40, 200), rng.permutation(200))]
    df = spark.createDataFrame(rows, "key string, id long, v int")
    got = stream_positions(df, "key", "id", 7, ties=("v",)).orderBy("pos").collect()
    assert [(r.id, r.v) for r in got] == sorted((i, v) for _, i, v in rows)
    assert [r.pos for r in got] == list(range(200))


def test_missing_keys_are_kept(spark):
    rows = [(i, None if i % 3 == 0 else "k", f"{(i * 7919) % 4096:03x}") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, key string, h string")
    got = hash_rank(df, ["key"], "h", rows_per_bucket=4).collect()
    assert len(got) == 30
    for key, n in ((None, 10), ("k", 20)):
        mine = sorted((r.h, r["rank"]) for r in got if r.key == key)
        assert [rank for _, rank in mine] == list(range(1, n + 1))


def test_positions_of_sparse_ids(spark):
    rng = np.random.default_rng(4)
    ids = sorted({int(x) for x in rng.integers(-2**60, 2**60, 700)})
    df = spark.createDataFrame([(i, "a" if j % 10 else "b") for j, i in enumerate(ids)], "id long, key string")
    got = sorted((r.key, r.id, r.pos) for r in stream_positions(df, "key", "id", 50).collect())
    for key in ("a", "b"):
        assert [p for k, _, p in got if k == key] == list(range(sum(k == key for k, _, _ in got)))


@pytest.mark.parametrize("rows_per_bucket", [5, 100_000])
def test_percentiles(spark, monkeypatch, rows_per_bucket):
    from siftguard.operators import running as module

    whole = module.quantile_bucket
    monkeypatch.setattr(module, "quantile_bucket", lambda df, c: whole(df, c, rows_per_bucket))
    rng = np.random.default_rng(5)
    rows = [("a" if i % 9 else None, float(np.round(x, 1))) for i, x in enumerate(rng.normal(size=500))] + [("a", None)]
    df = spark.createDataFrame(rows, "key string, v double")
    for r in module.percentiles(df, ["key"], "v", [0.0, 0.1, 0.5, 0.99, 1.0]).collect():
        mine = [v for k, v in rows if k == r.key and v is not None]
        assert np.allclose(r.cuts, np.quantile(mine, [0.0, 0.1, 0.5, 0.99, 1.0]))
