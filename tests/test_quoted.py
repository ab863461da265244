"""Log records with line breaks in quoted fields, read in splits of any length."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from siftguard.sources import readers
from siftguard.sources.quoted import quoted_records

HEADER = ["id", "date", "user", "pc", "filename", "content"]


def written(seed, rows, breaks):
    """Rows as a CSV text; about every third content has quotes, commas and line breaks."""
    pick = random.Random(seed)
    out = []
    for i in range(rows):
        parts = [pick.choice(["word", 'a "quoted" word', "one, two", "\n" * breaks, '"', "\n\n", "é"]) for _ in range(pick.randrange(4))]
        out.append([str(i), "01/04/2010 08:00:00", f"U{i % 3}", "PC1", f"f{i}.zip", "x".join(parts) or "x"])
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows([HEADER, *out])
    return text.getvalue(), out


@pytest.fixture()
def split_bytes(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def change(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", n)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)

    yield change
    for key, value in old.items():
        spark.conf.set(key, value)


def fields(log):
    return sorted((r.id, r.user, r.filename, r.content) for r in log.collect())


@pytest.mark.parametrize("length,breaks", [(37, 1), (64, 40), (300, 3), (1 << 20, 2)])
def test_records_across_splits(spark, tmp_path, split_bytes, length, breaks):
    folder = tmp_path / "file.csv"
    folder.mkdir()
    want = []
    for part in range(3):
        text, rows = written(part, 40, breaks)
        (folder / f"part-{part}.csv").write_text(text)
        want += rows
    split_bytes(length)
    log = readers.read_log(spark, str(folder), "file")
    assert fields(log) == sorted((r[0], r[2], r[4], r[5]) for r in want)
    assert log.filter(F.col("ts").isNull()).count() == 0


def test_one_field_over_many_splits(spark, tmp_path, split_bytes):
    content = "\n".join(f'line {i} with "quotes"' for i in range(60))
    text = io.StringIO()
    csv.writer(text, lineterminator="\r\n").writerows([HEADER, ["1", "d", "U", "P", "f", content], ["2", "d", "U", "P", "g", "h"]])
    (tmp_path / "file.csv").write_bytes(text.getvalue().encode())
    split_bytes(50)
    log = readers.read_log(spark, str(tmp_path / "file.csv"), "file")
    assert fields(log) == [("1", "U", "f", content), ("2", "U", "g", "h")]


def test_edges(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header.csv").write_text("id,date\n")
    (tmp_path / "open.csv").write_text('id,date\n1,2\n\n3,"no end\n4,5\n')
    got = {name: sorted(r.record for r in quoted_records(spark, str(tmp_path / f"{name}.csv")).collect()) for name in ("empty", "header", "open")}
    assert got == {"empty": [], "header": [], "open": ["1,2", '3,"no end\n4,5']}


def test_same_as_one_task_per_file(spark, tmp_path):
    text, _ = written(9, 200, 2)
    (tmp_path / "file.csv").write_text(text + '7,01/04/2010 08:00:00,U1\n8,01/04/2010 08:00:00,U1,PC1,"",\n')
    whole = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(str(tmp_path / "file.csv"))
    want = sorted((r.id, r.user, r.filename, r.content) for r in whole.filter("pc is not null").collect() if r.content is not None or r.id == "8")
    got = [tuple(r) for r in readers.read_log(spark, str(tmp_path / "file.csv"), "file").select("id", "user", "filename", "content").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
