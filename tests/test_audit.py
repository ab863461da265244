"""Log readers, user days, profiles and outliers on hand-written rows."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftguard.operators import neighbours, outliers, profiles, sampling, user_days
from siftguard.operators.user_days import FEATURES
from siftguard.sources import readers

LOGON = """id,date,user,pc,activity
1,01/04/2010 06:59:00,U1,PC1,Logon
2,01/04/2010 07:00:00,U1,PC1,Logon
3,01/04/2010 18:59:59,U1,PC1,Logon
4,01/04/2010 19:00:00,U1,PC1,Logon
5,01/04/2010 20:00:00,U1,PC2,Logoff
6,01/09/2010 10:00:00,U1,PC1,Logon
7,01/10/2010 10:00:00,U1,PC1,Logon
8,not a time,U1,PC1,Logon
9,01/04/2010 10:00:00,U3,PC9,Logoff
"""
DEVICE = """id,date,user,pc,activity
1,01/04/2010 08:00:00,U2,PC1,Disconnect
2,01/05/2010 06:00:00,U2,PC1,Connect
3,01/05/2010 09:00:00,U2,PC1,Connect
"""
EMAIL = '''id,date,user,pc,to,cc,bcc,from,size,attachments,content
1,01/04/2010 08:00:00,U1,PC1,a@dtaa.com;b@DTAA.com,,,me@dtaa.com,100,0,hi
2,01/04/2010 08:00:00,U1,PC1,a@dtaa.com,x@other.org;y@other.org,,me@dtaa.com,50.5,0,"quoted, comma
and ""line"" break"
3,01/04/2010 08:00:00,U1,PC1,,,,me@dtaa.com,abc,0,no recipients
4,01/04/2010 08:00:00,U1,PC1,a@dtaa.com,,,me@dtaa.com
5,01/04/2010 08:00:00,U1,PC1,a@dtaa.com,,,me@dtaa.com,7
'''
ANSWERS = """dataset,scenario,details,user,start,end
4.2,1,x.csv,U1,01/04/2010 10:00:00,01/06/2010 09:00:00
4.2,2,y.csv,U1,01/05/2010 10:00:00,01/05/2010 11:00:00
4.2,2,z.csv,U1,01/08/2010 10:00:00,01/07/2010 11:00:00
5.1,1,x.csv,U2,01/04/2010 10:00:00,01/06/2010 09:00:00
"""
FILES = """id,date,user,pc,filename,content
1,01/04/2010 08:00:00,U1,PC1,A.ZIP,x
2,01/04/2010 08:00:00,U1,PC1,b.exe.doc,x
3,01/04/2010 08:00:00,U1,PC1,c.7z
4,01/04/2010 08:00:00,U1,PC1
5,01/04/2010 08:00:00,U1,PC1,,x
"""


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    first, second = tmp_path_factory.mktemp("first"), tmp_path_factory.mktemp("second")
    (first / "logon.csv").write_text(LOGON)
    (second / "logon.csv").write_text("id,date,user,pc,activity\n")
    (second / "device.csv").write_text(DEVICE)
    (second / "email.csv").write_text(EMAIL)
    return readers.read_audit_logs(spark, [str(first), str(second)], multi_line=True)


def test_user_days(logs):
    days = user_days.user_day_features(logs["logon"], logs["device"], logs["file"], logs["email"])
    got = {(r.user, r.date): r for r in days.collect()}
    monday = got["U1", dt.date(2010, 1, 4)]
    assert (monday.logons, monday.logon_afterhours, monday.logon_weekend, monday.n_pc) == (4, 2, 0, 2)
    assert (monday.emails, monday.email_external, monday.email_bytes) == (4, 1, 157.5)
    assert got["U1", dt.date(2010, 1, 9)].logon_weekend == 1 and got["U1", dt.date(2010, 1, 10)].logon_weekend == 1
    assert ("U2", dt.date(2010, 1, 4)) not in got
    assert (got["U2", dt.date(2010, 1, 5)].usb_connects, got["U2", dt.date(2010, 1, 5)].usb_afterhours) == (2, 1)
    assert (got["U3", dt.date(2010, 1, 4)].logons, got["U3", dt.date(2010, 1, 4)].n_pc) == (0, 1)
    assert readers.rejected_rows(logs["logon"]).count() == 1
    assert logs["file"].count() == 0


def test_file_log(spark, logs, tmp_path):
    (tmp_path / "file.csv").write_text(FILES)
    log = readers.read_log(spark, str(tmp_path / "file.csv"), "file")
    empty = logs["device"].limit(0)
    day = user_days.user_day_features(logs["logon"].limit(0), empty, log, logs["email"].limit(0)).first()
    assert (day.file_copies, day.file_exe_zip) == (4, 2)


def test_intervals_and_labels(spark, logs, tmp_path):
    (tmp_path / "insiders.csv").write_text(ANSWERS)
    bad = sampling.malicious_user_days(readers.read_insider_intervals(spark, str(tmp_path / "insiders.csv")))
    assert sorted(r.date.day for r in bad.collect()) == [4, 5, 6]
    days = user_days.user_day_features(logs["logon"], logs["device"], logs["file"], logs["email"])
    labelled = user_days.label_user_days(days, bad)
    assert {(r.user, r.date.day) for r in labelled.collect() if r.label} == {("U1", 4)}
    grid = user_days.user_day_grid(labelled)
    cells = grid.collect()
    assert len(cells) == 3 * len({r.date for r in cells})
    assert all(getattr(r, f) is not None for r in cells for f in FEATURES)
    assert {r.day for r in cells} == set(range(len({r.date for r in cells})))
    assert user_days.user_day_summary(labelled).first().malicious == 1


def test_profile_by_hand():
    x = np.array([[[1.0], [3.0], [5.0], [2.0]]])
    z = profiles.exceedances(x, 0.9, 2)
    mean, var = 2.0, 1.0 + 1e-6
    assert z[0, 2, 0] == pytest.approx((5 - mean) / np.sqrt(var))
    mean = 0.9 * mean + 0.1 * 5
    var = 0.9 * var + 0.1 * (5 - mean) ** 2 + 1e-9
    assert z[0, 3, 0] == pytest.approx(max(0.0, (2 - mean) / np.sqrt(var)))
    assert (z[:, :2] == 0).all()


def test_fitness_groups_rates(spark):
    rng = np.random.default_rng(0)
    rows = [(f"u{u}", d, *rng.poisson(3, 2).astype(float).tolist(), int(u == 0 and d > 15)) for u in range(6) for d in range(20)]
    grid = spark.createDataFrame(rows, "user string, day int, p double, q double, label int")
    grid = grid.withColumn("p", F.when(F.col("label") == 1, F.col("p") + 20).otherwise(F.col("p")))
    series = profiles.user_series(grid, ["p", "q"]).persist()
    configs = [
        profiles.DetectorConfig((1.0, float(i % 2)), (1.0, 0.5), 1.0 + i / 4, 0.9 + 0.0104 * (i % 3)) for i in range(8)
    ]
    got = {r.config_id: r for r in profiles.detector_fitness(series, configs, 5, 0.15, None, ["p", "q"]).collect()}
    for i, c in enumerate(configs):
        z = profiles.profile_scores(series, c.forgetting, 5, ["p", "q"])
        scored = profiles.weighted_alarm(z, c, ["p", "q"]).filter("day >= 5").toPandas()
        assert got[i].tp == int(((scored.alarm == 1) & (scored.label == 1)).sum())
        assert got[i].fp == int(((scored.alarm == 1) & (scored.label == 0)).sum())
    best, history = profiles.tune_detector(
        series, profiles.TuneSettings(population=10, generations=3, warmup=5), features=["p", "q"]
    )
    assert history == sorted(history) and best.mask[0] == 1.0


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 2))
    x[0] = (9.0, 9.0)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(x)]
    return x, spark.createDataFrame(rows, "id int, a double, b double")


def test_isolation_forest_finds_the_outlier(cloud):
    _, df = cloud
    for sample in (64, 1024):
        scored = outliers.isolation_forest(df, df, ["a", "b"], ["id"], ["id"], trees=50, sample=sample)
        top = scored.orderBy(F.desc("outlier")).first()
        assert top.id == 0 and 0.6 < top.outlier <= 1.0
        assert scored.count() == 600


@pytest.mark.parametrize("block_rows", [20, 2_000])
def test_lof_against_brute_force(cloud, block_rows):
    x, df = cloud
    scored = outliers.local_outlier_factor(df, df, ["a", "b"], ["id"], ["id"], 10, block_rows)
    got = {r.id: r.outlier for r in scored.collect()}
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    own = dist + np.where(np.eye(600, dtype=bool), np.inf, 0)
    near = np.argsort(own, 1)[:, :10]
    reach = np.take_along_axis(own, near, 1)[:, -1]
    density = 1 / (np.maximum(reach[near], np.take_along_axis(own, near, 1)).mean(1) + 1e-10)
    for i in (0, 5, 77, 599):
        n = np.argsort(dist[i])[:10]
        local = 1 / (np.maximum(reach[n], dist[i][n]).mean() + 1e-10)
        assert got[i] == pytest.approx(density[n].mean() / local)
    assert max(got, key=got.get) == 0


def test_logs_count_and_long_fields(spark, tmp_path):
    for name, text in (("logon", LOGON), ("device", DEVICE), ("email", EMAIL), ("file", FILES)):
        (tmp_path / f"{name}.csv").write_text(text)
        assert readers.read_log(spark, str(tmp_path / f"{name}.csv"), name, True).count() >= 3
    long = EMAIL.splitlines()[0] + '\n1,01/04/2010 08:00:00,U1,PC1,a@b,,,c@d,1,0,"' + 'x, ""y"" ' * 25_000 + '",surplus\n'
    (tmp_path / "long.csv").write_text(long)
    rows = readers.read_log(spark, str(tmp_path / "long.csv"), "email")
    assert rows.count() == 1 and rows.first().user == "U1"


def test_results_of_two_experiments(spark, tmp_path):
    path = str(tmp_path / "results")
    for name in ("e1", "e2", "e1"):
        df = spark.createDataFrame([(1.0,)], "f1 double")
        readers.write_results(readers.long_results(df, name, F.lit("d"), F.lit("m"), ["f1"]), path)
    assert sorted(r.experiment for r in readers.read_results(spark, path).collect()) == ["e1", "e2"]


def test_alarm_cut_is_the_exact_percentile(spark):
    rng = np.random.default_rng(1)
    scores = np.round(rng.exponential(1, 700), 2)
    rows = [(f"u{i}", i % 7, float(x), int(rng.random() < 0.1)) for i, x in enumerate(scores)]
    df = spark.createDataFrame(rows, "user string, day int, outlier double, label int")
    rate = np.mean([r[3] for r in rows if r[1] < 4])
    cut = np.quantile([r[2] for r in rows if r[1] < 4], 1 - rate)
    got = outliers.outlier_alarms(df, 4).collect()
    assert len(got) == sum(r[1] >= 4 for r in rows)
    assert all(r.alarm == (r.outlier > cut + 1e-12) for r in got if abs(r.outlier - cut) > 1e-9)


def test_lof_uses_all_training_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6_000, 3))
    x[1::7] = x[0]
    points = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "point long, x array<double>")
    asked = points.filter("point % 500 = 3").withColumnRenamed("point", "query")
    got = outliers.nearest_rows(asked, points, 12, 500)
    found = {}
    for r in got.collect():
        found.setdefault(r["query"], []).append(r.dist)
    assert len(found) == 12
    for q, dist in found.items():
        want = np.sort(np.delete(np.sqrt(((x - x[q]) ** 2).sum(1)), q))[:12]
        assert np.allclose(sorted(dist), want)


def test_lof_collapses_equal_rows(spark):
    """Nine rows of ten are equal; the scores are those of a plain loop over all rows."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(500, 2)), 6)
    x[rng.random(500) < 0.9] = [0.0, 0.0]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    got = {r.id: r.outlier for r in outliers.local_outlier_factor(df, df, ["a", "b"], ["id"], ["id"], 10, 20).collect()}
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    own = dist + np.where(np.eye(500, dtype=bool), np.inf, 0)
    near = np.argsort(own, 1, kind="stable")[:, :10]
    reach = np.take_along_axis(own, near, 1)[:, -1]
    density = 1 / (np.maximum(reach[near], np.take_along_axis(own, near, 1)).mean(1) + 1e-10)
    for i in range(500):
        n = np.argsort(dist[i], kind="stable")[:10]
        local = 1 / (np.maximum(reach[n], dist[i][n]).mean() + 1e-10)
        assert got[i] == pytest.approx(density[n].mean() / local)


def test_nearest_rows_with_weights_and_equal_norms(spark):
    """Points on a sphere, some of them many times: each query gets the distances of a full search."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3_000, 4))
    x /= np.sqrt((x**2).sum(1))[:, None]
    weight = rng.choice([1, 1, 1, 5, 200], 3_000)
    points = spark.createDataFrame(
        [(i, row.tolist(), int(w)) for i, (row, w) in enumerate(zip(x, weight))], "point long, x array<double>, weight long"
    )
    asked = points.filter("point % 100 = 7").select(F.col("point").alias("query"), "x")
    got = outliers.nearest_rows(asked, points, 15, 100)
    found = {}
    for r in got.collect():
        found.setdefault(r["query"], []).extend([r.dist] * r.n)
    assert len(found) == 30
    for q, dist in found.items():
        copies = weight.copy()
        copies[q] -= 1
        want = np.sort(np.repeat(np.sqrt(((x - x[q]) ** 2).sum(1)), copies))[:15]
        assert np.allclose(sorted(dist), want, atol=1e-7)
    nothing = points.limit(0)
    assert outliers.nearest_rows(asked, nothing, 15).count() == 0
    assert outliers.nearest_rows(asked.limit(0), points, 15).count() == 0


def test_lof_searches_once_and_sends_back_what_is_in_reach(spark, cloud, monkeypatch):
    """One search for training rows and rows to be scored; a cell answers with points in reach only."""
    x, df = cloud
    searches, whole = [], outliers.nearest_rows
    monkeypatch.setattr(outliers, "nearest_rows", lambda *a: searches.append(1) or whole(*a))
    outliers.local_outlier_factor(df, df, ["a", "b"], ["id"], ["id"], 10, 20).count()
    assert len(searches) == 1

    far = np.array([0.3, 0.0, np.inf])
    asked = pa.table({"query": pa.array([-1, -2, -3]), "x": pa.array(list(x[:3])), "far": pa.array(far)})
    held = pa.table({"point": pa.array(range(600)), "x": pa.array(list(x)), "weight": pa.array([1] * 600)})
    got = neighbours._search(10)(asked, held).to_pandas()
    dist = np.sqrt(((x[:3, None] - x[None]) ** 2).sum(2))
    for i in range(3):
        want = np.sort(dist[i])[:10]
        assert np.allclose(got.dist[got["query"] == -1 - i], want[want <= far[i]])


def test_neighbour_cells_are_few_and_no_partner_is_lost():
    """Points on a lattice: a box is asked only if it lies in reach, whatever the number of cells."""
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 3, (8_000, 4)), rng.normal(size=8_000)]).astype(float)
    tree = neighbours._Tree.grow(x, 100)
    cell = tree.cells(x)
    ids = np.unique(cell)
    low, high = (np.array([f(x[cell == c], axis=0) for c in ids]) for f in (np.min, np.max))
    cells = neighbours._Cells(ids, np.bincount(cell)[ids], np.ones(len(ids), int), low, high)
    far = np.full(50, 0.2)
    row, at = cells.near(x[:50], far)
    dist = np.sqrt(((x[:50, None] - x[None]) ** 2).sum(2))
    asked = set(zip(row.tolist(), ids[at].tolist()))
    assert {(i, int(cell[j])) for i, j in zip(*np.nonzero(dist <= 0.2))} <= asked
    assert len(ids) > 80 and len(asked) < 50 * 5
