"""Near vectors, centroid clusters and spelling variants against plain loops."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from siftguard.llm.centroids import assign, cluster_vectors, squared
from siftguard.llm.hnsw import Graph
from siftguard.llm.near_vectors import audited_beam, near_vectors
from siftguard.llm.queries import ORACLES, QUERIES
from siftguard.llm.spelling import RUN, near_words, spelling_variants
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<double>, label int, node long, v string, shard string"


def rows_with_extras(rows):
    return [(i, v, 0, 1, "x", None) for i, v in rows]


def brute_links(rows, least):
    """n_links and component of every row that may link; rows stand for themselves."""
    unit = []
    for i, v in rows:
        good = i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array(v, float) / np.abs(np.array(v, float)).max() if good else None
        unit.append(x / np.sqrt((x * x).sum()) if good else None)
    links = [
        (a, b) for a in range(len(rows)) for b in range(a)
        if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least
    ]
    count = Counter(x for pair in links for x in pair)
    found = brute.components(range(len(rows)), links)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            smallest[found[k]] = min(i, smallest.get(found[k], i))
    out = []
    for k, (i, _) in enumerate(rows):
        c = None if i is None else smallest[found[k]]
        out.append((i, count[k], c, None if i is None else i == c))
    return sorted(out, key=repr)


def near_rows(seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(240):
        rows.append((i, rng.standard_normal(12).tolist()))
    base = rng.standard_normal(12)
    # A group of near copies, exact copies, a scaled one, a chain.
    rows += [(1000 + i, (base + 0.05 * rng.standard_normal(12)).tolist()) for i in range(40)]
    rows += [(500 + i, base.tolist()) for i in range(30)] + [(499, (1e200 * base).tolist())]
    x, y = np.eye(12)[:2]
    rows += [(2000 - i, (np.cos(0.3 * i) * x + np.sin(0.3 * i) * y).tolist()) for i in range(5)]
    rows += [(1, base.tolist()), (1, rows[5][1]), (None, base.tolist()), (3000, None), (3001, []), (3002, [0.0] * 12)]
    rows += [(3003, [None] + [1.0] * 11), (3004, [float("nan")] * 12), (3005, [float("inf")] + [0.0] * 11)]
    rows += [(3006, [2.0, 1.0]), (3007, [4.0, 2.0]), (3008, [5.0]), (3009, [7.0]), (3010, [-7.0]), (3011, [5e-324] + [0.0] * 11)]
    return rows


@pytest.mark.parametrize("shard_size", [10_000, 60])
def test_near_vectors(spark, shard_size):
    rows = near_rows()
    table = spark.createDataFrame(rows_with_extras(rows), SCHEMA)
    got, audits = near_vectors(table, shard_size=shard_size, shards_per_block=2)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_links(rows, 0.95)
    assert all(r["recall"] >= 0.995 for r in audits.collect())


def test_near_vectors_empty(spark):
    got, audits = near_vectors(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"] and got.count() == 0 and audits.count() == 0
    got, _ = near_vectors(spark.createDataFrame([(None, None)], "vec_id long, embedding array<float>"))
    assert [tuple(r) for r in got.collect()] == [(None, 0, None, None)]


def test_graph_recall_and_widening():
    rng = np.random.default_rng(5)
    units = rng.standard_normal((3000, 32))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    keys = np.arange(3000)
    graph = Graph(units.astype(np.float32), keys, m=8, beam=32)
    beam, recall = audited_beam(graph, units, keys, 0.95, 0.99, 400, 8)
    assert recall >= 0.99 and beam < 3000
    # A graph without links: only the beam that holds the whole shard can pass.
    for links in graph.links:
        links[:] = -1
    beam, recall = audited_beam(graph, units, keys, 0.95, 0.99, 50, 8)
    assert beam >= 3000 and recall == 1.0


def test_search_has_no_limit_of_partners():
    rng = np.random.default_rng(6)
    close = np.eye(16)[0] + 0.04 * rng.standard_normal((700, 16))
    units = np.concatenate([close, rng.standard_normal((300, 16))])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    graph = Graph(units.astype(np.float32), rng.permutation(1000), m=8, beam=16)
    rows, _ = graph.search(units[:1].astype(np.float32), 16, 0.9)
    assert len(rows) >= 0.95 * (units @ units[0] >= 0.9).sum() > 500


def brute_clusters(rows, k, rounds, size, scale=256, seed=2):
    kept = [
        (i, [int(np.floor(scale * x)) for x in v]) for i, v in rows
        if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v) and all(abs(scale * x) <= 2**27 for x in v)
    ]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in order[:k]]
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for r in range(rounds + 1):
        at = [min(range(len(centroids)), key=lambda j: (dist(v, centroids[j]), j)) for _, v in kept]
        if r < rounds:
            for j in set(at):
                own = [v for (_, v), c in zip(kept, at) if c == j]
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    d = [dist(v, centroids[c]) for (_, v), c in zip(kept, at)]
    per = Counter()
    for c, x in zip(at, d):
        per[c] += x
    return sorted(
        ((i, c, x, per[c], sum(d), brute.sha(",".join(map(str, centroids[c])))) for (i, _), c, x in zip(kept, at, d)), key=repr
    )


def cluster_rows(seed):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.integers(-3, 4, 6) / 8 + 0.05 * rng.standard_normal(6)).tolist()) for i in range(300)]
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, rows[4][1]), (400, [0.5] * 6), (401, [0.5] * 6)]
    return rows + [(500, None), (501, []), (502, [1.0] * 5), (503, [None] * 6), (504, [float("nan")] * 6), (505, [1e30] * 6), (506, [3e5] * 6)]


@pytest.mark.parametrize(("k", "rounds"), [(12, 5), (400, 3), (1, 2)])
def test_cluster_vectors(spark, k, rounds):
    rows = cluster_rows(k)
    table = spark.createDataFrame(rows_with_extras(rows), SCHEMA)
    got = cluster_vectors(table, k=k, rounds=rounds, size=6)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_clusters(rows, k, rounds, 6)


def test_clusters_of_nothing(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        got = cluster_vectors(spark.createDataFrame(rows_with_extras(rows), SCHEMA))
        assert got.columns[0] == "vec_id" and got.count() == 0


def test_bounds_leave_evaluations_out_and_ties_go_to_the_smaller():
    rng = np.random.default_rng(8)
    x = (rng.integers(0, 4, (2000, 8)) * 100 + rng.integers(0, 9, (2000, 8))).astype(np.int32)
    history = x[:16].astype(np.int64)[None]
    n, k = len(x), 16
    cluster, distance = np.zeros(n, np.int32), np.zeros(n, np.int64)
    low, last = np.zeros((n, k), np.float32), np.zeros((n, k), np.int8)
    used = []
    for _ in range(8):
        used.append(assign(x, cluster, distance, low, last, history))
        every = np.stack([squared(x, c) for c in history[-1]], axis=1)
        assert (cluster == every.argmin(axis=1)).all()
        moved = [x[cluster == j].astype(np.int64).sum(axis=0) // max(1, (cluster == j).sum()) for j in range(k)]
        history = np.concatenate([history, np.array(moved)[None]])
    assert used[0] == n * k and sum(used[1:]) < 0.6 * 7 * n * k


def brute_words(docs, least_length=5, least=3):
    import re

    counts = Counter()
    for i, text in docs:
        for run in re.findall(RUN, (text or "").translate(brute.LOW)):
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_forms(docs):
    words = brute_words(docs)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if words[b] >= 2 * words[w]}
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words.get(form.get(w))))
    return sorted(out, key=repr)


def test_spelling_variants(spark):
    rng = random.Random(4)
    stems = ["".join(rng.choice("abÀéz") for _ in range(rng.randrange(5, 9))) for _ in range(60)]
    docs = []
    for i in range(150):
        words = []
        for _ in range(40):
            w = rng.choice(stems[: 1 + int(rng.random() ** 2 * 60)])
            at = rng.randrange(len(w))
            words.append(rng.choice([w, w, w, w.upper(), w[:at] + w[at + 1:], w[:at] + rng.choice("abé") + w[at:], w[:at] + "x" + w[at + 1:]]))
        docs.append((i, rng.choice([" ", "\n", "1", "-", "Ā"]).join(words)))
    long = "q" * 3000 + "r" * 3000
    docs += [(200, None), (201, ""), (None, docs[0][1]), (5, docs[5][1]), (202, f"{long} {long} {long} {long}s {long}s {long}s")]
    table = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    assert sorted(map(tuple, spelling_variants(table).collect()), key=repr) == brute_forms(docs)


def test_every_single_edit_is_found(spark):
    rng = random.Random(9)
    words = set()
    for length in range(5, 14):
        w = "".join(rng.choice("abc") for _ in range(length))
        words |= {w[:i] + c + w[i:] for i in range(length + 1) for c in "aé"}
        words |= {w[:i] + w[i + 1:] for i in range(length)} | {w[:i] + "x" + w[i + 1:] for i in range(length)} | {w}
    words = sorted(w for w in words if len(w) >= 5)
    got = {frozenset(r) for r in near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {frozenset((a, b)) for k, a in enumerate(words) for b in words[:k] if one_edit(a, b)}


def test_spelling_of_nothing(spark):
    assert spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("name", ["op11_embedding_near_dedup", "op12_centroid_clustering", "op13_spelling_variants"])
def test_twins_are_there(name):
    assert name in ORACLES and name in QUERIES
