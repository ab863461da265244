"""Licence texts that are wrapped or stand within paragraphs, against all windows in plain loops."""

import random
import re
import textwrap
import time

import pytest

from siftguard.llm.licenses import NOTICES, TEXTS, scan_licenses, scan_texts, with_texts

SMALL = {"MIT": (NOTICES["MIT"][0],), "BSD-3-Clause": (NOTICES["BSD-3-Clause"][1],), "proprietary": ("All rights reserved.",)}


def _plain(text, notices, num=4, den=5):
    words = [(w, at) for at, line in enumerate((text or "").split("\n"), 1) for w in re.findall("[a-z0-9]+", line.lower())]
    grams = [f"{a} {b}" for (a, _), (b, _) in zip(words, words[1:])]
    found = []
    for name, texts in notices.items():
        for k, notice in enumerate(texts):
            own = re.findall("[a-z0-9]+", notice.lower())
            wanted = {f"{a} {b}" for a, b in zip(own, own[1:])}
            most = (2 * den - num) * len(own) // num - 1
            passages = []
            for i in range(len(grams)):
                for j in range(i, min(i + most, len(grams))):
                    held = set(grams[i : j + 1])
                    n, shared = len(held), len(held & wanted)
                    if grams[i] in wanted and grams[j] in wanted and 2 * den * shared >= num * (n + len(wanted)):
                        new = (2 * shared / (n + len(wanted)), -i, -j, n, shared)
                        if passages and i <= passages[-1][0]:
                            passages[-1] = (max(j, passages[-1][0]), max(new, passages[-1][1]))
                        else:
                            passages.append((j, new))
            found += [(words[-i][1], 1 - i, i - j + 2, name, k, n, s) for _, (_, i, j, n, s) in passages]
    return found


def _found(df):
    return sorted(tuple(r)[:8] for r in df.collect())


def test_all_windows(spark):
    rng = random.Random(5)
    parts = [w for texts in SMALL.values() for t in texts for w in (t, t, t.split()[0], " ".join(t.split()[1:]), f"{t}\n{t}")]
    docs = []
    for i in range(150):
        text = " ".join(rng.choice([rng.choice(parts), "x", "the MIT", "\n", "- a license"]) for _ in range(rng.randint(1, 9)))
        words = text.split(" ")
        words[rng.randrange(len(words))] = rng.choice(["\n", "new", "", "License\n"])
        docs.append((i % 140, " ".join(words)))
    docs += [(1000, None), (1001, ""), (1002, "license"), (None, "All rights\n\nreserved.")]
    want = sorted(((i, *r) for i, t in docs for r in _plain(t, SMALL)), key=repr)
    got = sorted(_found(scan_texts(spark.createDataFrame(docs, "doc_id long, text string"), SMALL).na.fill(-1, ["doc_id"])), key=repr)
    assert got == sorted(((-1 if r[0] is None else r[0], *r[1:]) for r in want), key=repr)
    assert len(want) > 60


@pytest.mark.parametrize("name, number", [("MIT", 2), ("MIT", 3), ("BSD-3-Clause", 0), ("BSD-3-Clause", 2), ("GPL-3.0", 1), ("GPL-2.0", 1)])
def test_wrapped_texts(spark, name, number):
    text = with_texts()[name][number]
    doc = "Some words before.\n" + textwrap.fill(text, 50) + "\nSome words after."
    docs = spark.createDataFrame([(1, doc)], "doc_id long, text string")
    got = {(r.license, r.notice): (r.line, r.dice) for r in scan_texts(docs).collect()}
    assert got[(name, number)] == (2, 1.0)
    assert (name, number) not in {(r.license, r.notice) for r in scan_licenses(docs).collect()}


def test_notices_within_a_line(spark):
    docs = spark.createDataFrame([
        (1, "Copyright (c) 2020 Example Inc. All rights reserved."),
        (2, "We wrote this in May. Released under the MIT License. Send us a note if you use it."),
        (3, "Nothing is licensed here, and no rights are reserved."),
    ], "doc_id long, text string")
    assert {(r.doc_id, r.license) for r in scan_texts(docs).collect()} == {(1, "proprietary"), (2, "MIT")}
    assert scan_licenses(docs).count() == 0


def test_texts_are_numbered_after_notices():
    assert all(with_texts()[k][: len(v)] == v for k, v in NOTICES.items())
    assert all(with_texts()[k][-len(v) :] == v for k, v in TEXTS.items())


@pytest.mark.parametrize("copies", [1, 2, 3])
def test_neighbouring_copies(spark, copies):
    """Windows that bridge neighbouring copies make one passage of them, as the plain loops say."""
    notices = {"MIT": (TEXTS["MIT"][0],)}
    text = "\nSome words between.\n".join([TEXTS["MIT"][0]] * copies)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert _found(scan_texts(docs, notices)) == sorted((1, *r) for r in _plain(text, notices))


def test_many_copies_in_one_text(spark):
    """Every copy that stands apart is found, in time that grows with their number, not faster."""
    between, seconds = " ".join(f"word{i}" for i in range(300)), {}
    for copies in (1, 50, 500):
        docs = spark.createDataFrame([(1, f"\n{between}\n".join([TEXTS["MIT"][0]] * copies))], "doc_id long, text string")
        start = time.perf_counter()
        got = [r for r in scan_texts(docs).collect() if (r.license, r.notice) == ("MIT", len(NOTICES["MIT"]))]
        seconds[copies] = time.perf_counter() - start
        assert len(got) == copies and all(r.dice == 1.0 for r in got)
    assert seconds[500] <= 10 * seconds[50]
