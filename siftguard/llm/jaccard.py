"""N-gram Jaccard join by a token-group matrix.

Each document is a set of word n-grams, kept as 64-bit hashes. Documents with equal sets (by two
such sums) are one class. A set that links with another one shares at least num / den of its n-grams
with it, so a first pass finds, for every class, the n-grams that other classes have as well; most
documents have too few of them and leave here, among them all that only share a passage.

The others are partitioned into groups of similar documents: those with the same least shared
n-gram. The matrix (token, group) has a row per group, the union of its members' n-grams. A
query looks up its rarest tokens only: if it needs c common ones out of s, one of the s - c + 1
rarest must be common. In the groups found so the number of its n-grams in the group's
union bounds its overlap with every member; only groups that reach the required number are
opened, and their members compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftguard.llm.components import components
from siftguard.llm.release import release
from siftguard.llm.words import SPACES, lists, mix, pieces
from siftguard.session import discard, materialize, spread

BLOCK_TOKENS = 1_000_000
# N-grams that a counting task holds.
TASK_GRAMS = 2_000_000
_FP = np.uint64(0xD6E8FEB86659FD93)


def _ngrams(hashes: np.ndarray, first: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each document; fewer words than n make one n-gram."""
    if not len(hashes):
        return [np.zeros(0, np.uint64)] * (len(first) - 1)
    grams = np.full(len(hashes), np.uint64(n))
    for i in range(n):
        m = max(len(hashes) - i, 0)
        grams[:m] = mix(grams[:m] * _FP + hashes[i: i + m])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            found = np.sort(grams[a: b - n + 1])
            out.append(found[np.concatenate(([True], found[1:] != found[:-1]))])
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for i in range(a, b):
                whole = mix(whole * _FP + hashes[i: i + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


SKETCH = "doc_id long, n_shingles long, fp1 long, fp2 long"
# kind 0: n-grams that only one class of a piece has; 1: those that several have, without
# classes; 2: their classes. Classes (by fp1) and their n-grams stand side by side.
ENTRIES = "bucket int, kind int, keys array<long>, counts array<int>, grams array<long>"


def _prints(sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((2, len(sets)), np.uint64)
    for i, grams in enumerate(sets):
        out[0, i] = mix(grams).sum(dtype=np.uint64)
        out[1, i] = mix(grams * _FP + np.uint64(1)).sum(dtype=np.uint64)
    return out


def _sketches(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1), SPACES, lower=True):
                sets = _ngrams(piece.hashes(), piece.first, n)
                prints = _prints(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(piece.rows.start, len(piece.rows)),
                    pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[0]), pa.array(prints[1]),
                ], ["doc_id", "n_shingles", "fp1", "fp2"])

    return run


def _dealt(kind: int, keys: np.ndarray, grams: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """One row per bucket; n-grams of a class stand together."""
    order = np.lexsort((keys, bucket))
    keys, grams, bucket = keys[order], grams[order], bucket[order]
    change = np.concatenate(([True], bucket[1:] != bucket[:-1]))
    heads = np.flatnonzero(change | np.concatenate(([True], keys[1:] != keys[:-1])))
    rows = np.flatnonzero(change)
    ends = np.append(rows, len(grams))
    counts = np.diff(np.append(heads, len(grams)))
    key_ends = np.searchsorted(heads, ends).astype(np.int32)
    return pa.RecordBatch.from_arrays([
        pa.array(bucket[rows].astype(np.int32)), pa.array(np.full(len(rows), kind, np.int32)), lists(keys[heads], key_ends),
        pa.ListArray.from_arrays(pa.array(key_ends), pa.array(counts, pa.int32())), lists(grams, ends),
    ], ["bucket", "kind", "keys", "counts", "grams"])


def _entries(n: int, buckets: int):
    """N-grams of a task's classes, dealt to buckets.

    An n-gram that several classes of a piece have is known to be shared: it goes to its bucket
    once, and its classes to buckets of their own, so that neither an n-gram that very
    many classes have nor a class with very many copies falls to one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for piece in pieces(batch.column(1), SPACES, lower=True):
                sets = _ngrams(piece.hashes(), piece.first, n)
                prints = _prints(sets)
                some = []
                for i in range(len(sets)):
                    key = prints[:, i].tobytes()
                    # Copies in one task would only repeat the first one.
                    if len(sets[i]) and key not in seen:
                        seen.add(key)
                        some.append(i)
                if not some:
                    continue
                grams = np.concatenate([sets[i] for i in some])
                keys = np.repeat(prints[0, some], [len(sets[i]) for i in some])
                order = np.argsort(grams, kind="stable")
                grams, keys = grams[order], keys[order]
                first = np.concatenate(([True], grams[1:] != grams[:-1]))
                once = first & np.append(first[1:], True)
                at = (mix(grams) % np.uint64(buckets)).astype(np.int64)
                if once.any():
                    yield _dealt(0, keys[once], grams[once], at[once])
                if not once.all():
                    several = first & ~once
                    yield _dealt(1, np.zeros(several.sum(), np.uint64), grams[several], at[several])
                    by_pair = (mix(grams ^ mix(keys + _FP)) % np.uint64(buckets)).astype(np.int64)
                    yield _dealt(2, keys[~once], grams[~once], by_pair[~once])

    return run


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _held(batches: Iterator[pa.RecordBatch]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """N-grams and their classes of all rows of a task, by kind."""
    held: dict[int, list] = {0: [], 1: [], 2: []}
    for batch in batches:
        kinds = batch.column(1).to_numpy()
        for kind, parts in held.items():
            rows = batch.filter(pa.array(kinds == kind))
            if rows.num_rows:
                keys, counts = _flat(rows.column(2)).view(np.uint64), _flat(rows.column(3))
                grams = _flat(rows.column(4)).view(np.uint64)
                parts.append((grams, np.repeat(keys, counts)))
    return {k: tuple(np.concatenate([h[i] for h in v]) if v else np.zeros(0, np.uint64) for i in (0, 1)) for k, v in held.items()}


def _distinct(grams: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order of n-grams, then classes."""
    order = np.lexsort((keys, grams))
    grams, keys = grams[order], keys[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (keys[1:] != keys[:-1])
    return grams[new], keys[new]


def _shared(buckets: int):
    """Of each class the n-grams that another class has as well, dealt to buckets by class.

    A task holds whole buckets of n-grams.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _held(batches)
        grams, keys = _distinct(*held[0])
        if len(grams):
            first = np.concatenate(([True], grams[1:] != grams[:-1]))
            many = ~first | ~np.append(first[1:], True) | np.isin(grams, held[1][0])
            grams, keys = grams[many], keys[many]
        others = _distinct(*held[2])
        grams, keys = np.concatenate([grams, others[0]]), np.concatenate([keys, others[1]])
        if len(grams):
            yield _dealt(0, keys, grams, (mix(keys) % np.uint64(buckets)).astype(np.int64))

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per class with its shared n-grams in order; a task holds whole buckets of classes."""
    keys, grams = _distinct(*reversed(_held(batches)[0]))
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    ends = np.append(heads, len(keys))
    # Spark's order of longs.
    for i in range(0, len(heads), 10_000):
        part = ends[i: i + 10_001]
        some = np.concatenate([np.sort(grams[a:b].view(np.int64)) for a, b in zip(part[:-1].tolist(), part[1:].tolist())])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[part[:-1]].view(np.int64)), lists(some, part - part[0])], ["fp1", "grams"]
        )


def _links_to(grams, size, flat, heads, sizes, num, den) -> np.ndarray:
    """Which of many sets link with one. Sets hold shared n-grams only; sizes are whole."""
    at = np.searchsorted(grams, flat)
    at[at == len(grams)] = 0
    both = np.add.reduceat((grams[at] == flat).astype(np.int64), heads)
    return den * both >= num * (sizes + size - both)


class _Block:
    """Members of a group, or of a block of it, with their row of the matrix."""

    def __init__(self, members: list[tuple[int, int, np.ndarray]], num: int, den: int):
        self.ids = np.array([i for i, _, _ in members], np.int64)
        self.sizes = np.array([s for _, s, _ in members], np.int64)
        self.sets = [g for _, _, g in members]
        lengths = np.array([len(g) for g in self.sets], np.int64)
        self.flat = np.concatenate(self.sets) if members else np.zeros(0, np.int64)
        self.heads = np.cumsum(lengths) - lengths
        self.num, self.den = num, den
        self._union: np.ndarray | None = None

    def asked(self, size: int, grams: np.ndarray) -> list[int]:
        """Members that link with a query; the block is opened if the bound allows any."""
        if not len(self.ids):
            return []
        if self._union is None:
            self._union = np.unique(self.flat)
        at = np.searchsorted(self._union, grams)
        at[at == len(self._union)] = 0
        most = int((self._union[at] == grams).sum())
        if self.den * most < self.num * max(size, int(self.sizes.min())):
            return []
        return self.ids[_links_to(grams, size, self.flat, self.heads, self.sizes, self.num, self.den)].tolist()

    def inner(self) -> Iterator[tuple[int, int]]:
        """Links that connect what the links of the members connect.

        From each member not reached yet the reached ones are followed, every member compared
        with those not yet reached.
        """
        left, waiting = np.arange(len(self.ids)), []
        while len(left):
            at = waiting.pop() if waiting else int(left[0])
            left = left[left != at]
            if not len(left):
                break
            few = len(left) < len(self.ids) // 2
            flat = np.concatenate([self.sets[i] for i in left]) if few else self.flat
            lengths = np.array([len(self.sets[i]) for i in left], np.int64) if few else None
            heads = np.cumsum(lengths) - lengths if few else self.heads
            sizes = self.sizes[left] if few else self.sizes
            hit = _links_to(self.sets[at], int(self.sizes[at]), flat, heads, sizes, self.num, self.den)
            found = left[hit if few else hit[left]]
            for j in found.tolist():
                yield int(self.ids[at]), int(self.ids[j])
                waiting.append(j)
            left = np.setdiff1d(left, found)


def _verify(num: int, den: int):
    """Columns gid, a, b, role, id, size, grams; of one block members (role 0) come before queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, block, links = None, [], None, []

        def close():
            nonlocal block
            if key is not None and block is None:
                block = _Block(members, num, den)
            if key is not None and key[1] == key[2]:
                links.extend(block.inner())

        for batch in batches:
            bounds = batch.column(6).offsets.to_numpy()
            flat = batch.column(6).values.to_numpy(zero_copy_only=False)
            rows = zip(*[batch.column(i).to_pylist() for i in range(6)])
            for k, (gid, a, b, role, i, size) in enumerate(rows):
                if (gid, a, b) != key:
                    close()
                    key, members, block = (gid, a, b), [], None
                grams = flat[bounds[k]: bounds[k + 1]]
                if not role:
                    members.append((i, size, grams.copy()))
                    continue
                if block is None:
                    block = _Block(members, num, den)
                links.extend((i, j) for j in block.asked(size, grams))
            if len(links) > 10_000:
                yield pa.RecordBatch.from_pydict({"a": [x for x, _ in links], "b": [x for _, x in links]})
                links = []
        close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], ["a", "b"]
        )

    return run


def ngram_jaccard(
    docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, block_tokens: int = BLOCK_TOKENS,
    task_grams: int = TASK_GRAMS,
) -> DataFrame:
    """Components of documents whose n-gram sets link: den * |A and B| >= num * |A or B|.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable by links). Words are
    runs of characters other than ASCII white space, A-Z lower-cased. Null and empty texts
    have no set: n_shingles 0, a component of their own. Rows with equal texts are linked. A
    row that repeats a doc_id (and its text) is returned each time, with one component; rows
    without a doc_id are returned with a null component. Other columns are ignored. The work
    is done when this is called. N-grams are counted in tasks of about ``task_grams``; groups
    above ``block_tokens`` n-grams are compared in blocks.
    """
    # Joins by hints: tables that grow with the corpus are joined in one way at every size.
    docs = spread(docs.select("doc_id", "text"))
    spark = docs.sparkSession
    known = docs.filter("doc_id is not null")
    sketch = materialize(known.mapInArrow(_sketches(n), SKETCH), "sketch")
    full = sketch.filter("n_shingles > 0")
    classes = materialize(
        full.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size")), "classes"
    )

    # N-grams that more than one class has.
    total = classes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // task_grams))
    entries = known.mapInArrow(_entries(n, 4 * tasks), ENTRIES).repartition(tasks, "bucket")
    by_class = entries.mapInArrow(_shared(4 * tasks), ENTRIES).repartition(tasks, "bucket")
    found = by_class.mapInArrow(_gathered, "fp1 long, grams array<long>")
    # What links with another set shares num / den of its n-grams with it.
    sets = materialize(
        found.join(classes.hint("merge"), "fp1").filter(F.size("grams") * den >= F.col("size") * num).select("rep", "size", "grams"),
        "sets",
    )
    release(spark)

    # The same among those that are left, rarest first; the least n-gram is the group.
    each = sets.select("rep", "size", F.explode("grams").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1")
    ranked = each.join(often.hint("merge"), "token").groupBy("rep").agg(
        F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("c", "token"))).alias("ranked")
    ).filter(F.size("ranked") * den >= F.col("size") * num)
    needed = F.ceil(F.col("size") * num / F.lit(den))
    chosen = materialize(ranked.select(
        "rep", "size", F.array_min("ranked.token").alias("gid"),
        F.col("ranked.token").alias("tokens"),
        (F.size("ranked") - needed + 1).cast("int").alias("rare"),
    ).withColumn("tokens", F.slice("tokens", F.lit(1), F.col("rare"))).drop("rare"), "groups")
    groups = chosen.groupBy("gid").agg(
        F.count("*").alias("n"), F.sum("size").alias("total"), F.min("size").alias("low"), F.max("size").alias("high")
    ).withColumn("blocks", F.ceil(F.col("total") / block_tokens).cast("int"))
    # A large group is cut into blocks; each pair of blocks is one piece of work.
    placed = materialize(chosen.drop("tokens").join(groups.hint("merge"), "gid").select(
        "gid", "rep", "size", "n", "low", "high", "blocks",
        F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"),
    ), "placed")
    release(spark)

    def verified(work: DataFrame) -> DataFrame:
        rows = work.hint("merge").join(sets.withColumnRenamed("rep", "id"), "id")
        rows = rows.select("gid", "a", "b", "role", "id", "size", "grams")
        ordered = rows.repartition("gid", "a", "b").sortWithinPartitions("gid", "a", "b", "role", "id")
        return ordered.mapInArrow(_verify(num, den), "a long, b long")

    inner = placed.filter("n > 1").select(
        "gid", "rep",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(
            F.least(i, F.col("block")).alias("a"), F.greatest(i, F.col("block")).alias("b"),
            (i < F.col("block")).cast("int").alias("role"),
        ))).alias("at"),
    ).select("gid", "at.a", "at.b", "at.role", F.col("rep").alias("id"))
    within = materialize(components(verified(inner)), "within-groups")
    release(spark)

    # Component of every class, and the first and last component of its group.
    so_far = placed.join(within.hint("merge"), placed.rep == within.id, "left").select(
        "gid", "rep", "n", "low", "high", "blocks", F.coalesce("component_id", "rep").alias("component")
    )
    reach = so_far.groupBy("gid").agg(F.min("component").alias("first"), F.max("component").alias("last"))
    so_far = materialize(so_far.join(reach.hint("merge"), "gid"), "so-far")

    # The matrix, by the tokens that may be looked up. Of two groups the smaller one's members
    # are queries; a group that hangs together with the query already need not be asked.
    asking = so_far.join(chosen.select("rep", "size", F.explode("tokens").alias("token")).hint("merge"), "rep")
    matrix = asking.groupBy("token", F.col("gid").alias("other")).agg(
        *[F.first(c).alias(f"other_{c}") for c in ("n", "low", "high", "first", "last", "blocks")]
    )
    opened = asking.select("token", "rep", "size", "gid", "n", "component").join(matrix.hint("merge"), "token").filter(
        (F.expr("(n < other_n or (n = other_n and gid < other)) and not (other_first = component and other_last = component)"))
        & (F.col("other_high") * den >= F.col("size") * num) & (F.col("other_low") * num <= F.col("size") * den)
    ).groupBy("rep", "other").agg(F.first("other_blocks").alias("blocks"))
    opened = materialize(opened, "opened")
    release(spark)
    hosts = placed.join(opened.select(F.col("other").alias("gid")).distinct().hint("merge"), "gid", "left_semi").select(
        "gid", F.col("block").alias("a"), F.lit(-1).alias("b"), F.lit(0).alias("role"), F.col("rep").alias("id")
    )
    visits = opened.select(
        F.col("other").alias("gid"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("a"),
        F.lit(-1).alias("b"), F.lit(1).alias("role"), F.col("rep").alias("id"),
    )
    edges = materialize(verified(hosts.union(visits)), "links").union(
        within.select(F.col("id").alias("a"), F.col("component_id").alias("b"))
    )
    discard(sets, chosen, placed, so_far, opened)
    release(spark)
    joined = materialize(components(edges), "components")
    named = classes.select("fp1", "fp2", "rep").join(joined.hint("merge"), F.col("rep") == F.col("id"), "left").select(
        "fp1", "fp2", F.coalesce("component_id", "rep").alias("component_id")
    )
    linked = full.join(named.hint("merge"), ["fp1", "fp2"]).select("doc_id", "n_shingles", "component_id")
    empty = sketch.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    unnamed = docs.filter("doc_id is null").mapInArrow(_sketches(n), SKETCH).select(
        "doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")
    )
    return linked.union(empty).union(unnamed)
