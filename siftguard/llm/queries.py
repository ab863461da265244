"""One query per operator on its whole table, with a SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from siftguard.llm.centroids import cluster_vectors
from siftguard.llm.decontaminate import find_benchmark
from siftguard.llm.host_quality import judge
from siftguard.llm.jaccard import ngram_jaccard
from siftguard.llm.licenses import scan_licenses, scan_sql, scan_texts
from siftguard.llm.lines import drop_common_lines
from siftguard.llm.mixing import mix_sources
from siftguard.llm.near_vectors import near_vectors
from siftguard.llm.quality_classifier import score_quality
from siftguard.llm.sharding import shard_rows
from siftguard.llm.spelling import spelling_variants
from siftguard.llm.substrings import remove_repeats
from siftguard.llm.toxicity import score_toxicity
from siftguard.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    def add(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_ngram_jaccard", rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array({LOWER_SQL}, '[\x20\x09-\x0D]+') IF x <> ''] AS ws
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE [array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b USING (s)
      WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * c >= 85 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION
  SELECT reach.doc_id, ways.b FROM reach JOIN ways ON ways.a = reach.r)
SELECT reach.doc_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id
FROM reach LEFT JOIN n ON n.doc_id = reach.doc_id GROUP BY reach.doc_id
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(table(spark, sf_dir, "documents"))


@query("op6_line_dedup", rf"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line FROM s, unnest(range(1, len(ls) + 1)) t(i)),
k AS (
  SELECT doc_id, i, line, {LOWER_SQL.replace("coalesce(text, '')", "regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS key
  FROM l),
c AS (SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= 20
      GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
d AS (SELECT doc_id, i, line, coalesce(doc_id < largest, false) AS dropped FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM d GROUP BY doc_id
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_common_lines(table(spark, sf_dir, "documents")).drop("kept")


ALNUM_SQL = rf"regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op7_benchmark_decontamination", rf"""
WITH it AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {ALNUM_SQL} AS ws FROM benchmark),
im AS (SELECT item_id, ws, least(len(ws), 10) AS m FROM it WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS key
       FROM im, unnest(range(1, len(ws) - m + 2)) t(i)),
ms AS (SELECT DISTINCT m FROM iw),
d AS (SELECT doc_id, {ALNUM_SQL} AS ws FROM documents),
dw AS (SELECT doc_id, i, m, array_to_string(ws[i:i + m - 1], ' ') AS key
       FROM d, ms, unnest(range(1, len(ws) - m + 2)) t(i)),
h AS (SELECT doc_id, i, m, item_id FROM dw JOIN iw USING (m, key)),
hw AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM h, unnest(range(i, i + m)) t(j) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
       FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


WORDS_SQL = r"[x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> '']"


@query("op10_substring_dedup", rf"""
WITH w AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS key FROM w, unnest(range(1, len(ws) - 48)) t(i)),
lows AS (SELECT key, min(doc_id) AS low FROM win GROUP BY key),
hit AS (SELECT doc_id, i FROM win JOIN lows USING (key) WHERE low < doc_id),
j AS (SELECT w.doc_id, t.i, ws[t.i] AS word FROM w, unnest(range(1, len(ws) + 1)) t(i)),
m AS (SELECT j.doc_id, j.i, word,
        max(CASE WHEN hit.i IS NULL THEN 0 ELSE 1 END)
          OVER (PARTITION BY j.doc_id ORDER BY j.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
      FROM j LEFT JOIN hit ON hit.doc_id = j.doc_id AND hit.i = j.i),
r AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM m GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))[0]


@query("op2_license_scan", scan_sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


@query("op2_license_texts")
def op2_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence texts and notices across lines; ``op2_license_scan`` keeps to single lines, as its twin does."""
    return scan_texts(table(spark, sf_dir, "documents"))


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _prior(name: str) -> str:
    return f"""(SELECT least(greatest(CASE WHEN b > 0 THEN c / b - 1 ELSE 1e6 END, 1.0), 1e6) FROM (
      SELECT m * (1 - m) AS c, v / t - m * (1 - m) * hosts / t AS b FROM (
        SELECT any_value(m) AS m, sum(n * pow(f_{name} / n - m, 2.0)) AS v, sum(n) AS t, count(*) AS hosts
        FROM h, (SELECT sum(f_{name}) / sum(n) AS m FROM h))))"""


RULES_SQL = {
    "short": "n_words < 50", "repeats": "100 * n_repeat_words > 50 * n_words", "symbols": "10 * n_symbols > 3 * n_words",
    "dup_lines": "2 * n_dup_lines > n_lines", "word_length": "(word_chars < 2 * n_words OR word_chars > 15 * n_words)",
}
ALL_SQL = {**RULES_SQL, "any": "(" + " OR ".join(RULES_SQL.values()) + ")"}


@query("op4_quality_rules", rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS_SQL} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS key FROM w, unnest(range(1, len(ws) - 1)) t(i)),
gg AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, key) AS c FROM g),
rw AS (SELECT doc_id, count(DISTINCT j) AS n FROM gg, unnest(range(i, i + 3)) t(j) WHERE c > 1 GROUP BY doc_id),
ln AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
       WHERE regexp_matches(line, '[^ 	-
]')),
nl AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln GROUP BY doc_id),
m AS (
  SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words
  FROM w LEFT JOIN nl USING (doc_id) LEFT JOIN rw USING (doc_id)),
h AS (SELECT source, count(*) AS n, {", ".join(f"sum(CASE WHEN {r} THEN 1 ELSE 0 END) AS f_{x}" for x, r in ALL_SQL.items())}
      FROM m GROUP BY source),
p AS (SELECT {", ".join(f"(SELECT sum(f_{x}) / sum(n) FROM h) AS m_{x}, {_prior(x)} AS s_{x}" for x in ALL_SQL)}),
r AS (SELECT source, {", ".join(f"(f_{x} + m_{x} * s_{x}) / (n + s_{x}) AS rate_{x}" for x in ALL_SQL)} FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({RULES_SQL["short"]} OR {RULES_SQL["repeats"]}) AS base_failed,
       NOT ({RULES_SQL["short"]} OR {RULES_SQL["repeats"]}) AND rate_any < 0.5
         AND NOT ({" OR ".join(f"({x} AND rate_{n} >= 0.02)" for n, x in RULES_SQL.items())}) AS kept
FROM m JOIN r ON m.source IS NOT DISTINCT FROM r.source
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


@query("op5_source_mix", rf"""
WITH w AS (SELECT doc_id, source, CAST(len({WORDS_SQL}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM w GROUP BY source),
g AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS src FROM s),
gw AS (SELECT *, [3, 1, 2][(src - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM g),
lv AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE)
      - CAST(sum(cap) OVER () - sum(cap) OVER above AS DOUBLE)) / CAST(sum(weight) OVER above AS DOUBLE) AS level
  FROM gw WINDOW above AS (ORDER BY cap / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
lc AS (SELECT *, cap / weight <= level AS capped FROM lv),
t AS (SELECT source, src, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE)
        ELSE weight * max(CASE WHEN NOT capped THEN level END) OVER () END AS target FROM lc),
q AS (SELECT src, target / (2 * k - 1) AS quotient FROM t, range(1, CAST(target / 128 AS BIGINT) + (SELECT count(*) + 3 FROM t)) r(k)
      WHERE target > 0),
sq AS (SELECT src, count(*) AS quota FROM (SELECT src, row_number() OVER (ORDER BY quotient DESC, src) AS n FROM q)
       WHERE n <= (SELECT round(sum(target) / 128) FROM t) GROUP BY src),
d AS (
  SELECT doc_id, size, t.src, source_size, target, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM w JOIN t ON w.source IS NOT DISTINCT FROM t.source),
ds AS (SELECT *, CAST('0x' || substr(key, 1, 8) AS BIGINT) % CAST(greatest(ceil(source_size / 1000000), 1) AS BIGINT) AS shard FROM d),
p AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY src, shard ORDER BY key, doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM ds),
sh AS (SELECT src, shard, CAST(sum(size) AS BIGINT) AS words FROM p GROUP BY src, shard HAVING sum(size) > 0),
shq AS (SELECT src, shard, words / (2 * k - 1) AS quotient, quota FROM sh JOIN sq USING (src), range(1, quota + 1) r(k)),
won AS (SELECT src, shard, count(*) AS quota FROM (
          SELECT *, row_number() OVER (PARTITION BY src ORDER BY quotient DESC, shard) AS n FROM shq) WHERE n <= quota
        GROUP BY src, shard),
qu AS (SELECT src, shard, CAST(ceil(words / 128) AS BIGINT) AS blocks,
         least(coalesce(quota, 0), 2 * CAST(ceil(words / 128) AS BIGINT)) AS quota FROM sh LEFT JOIN won USING (src, shard)),
lots AS (SELECT src, shard, block, quota % blocks AS wanted, row_number() OVER (PARTITION BY src, shard
           ORDER BY md5('mix:' || src || ':' || shard || ':' || block), block) AS n FROM qu, range(0, blocks) r(block)),
parts AS (
  SELECT p.src, p.shard, p.start, sum(least(start + size, (block + 1) * 128) - greatest(start, block * 128)) AS part
  FROM p JOIN lots ON p.src = lots.src AND p.shard = lots.shard AND n <= wanted
    AND block * 128 < start + size AND (block + 1) * 128 > start
  WHERE size > 0 GROUP BY ALL)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0
    ELSE quota // blocks * size + coalesce(part, 0) END AS BIGINT) AS taken
FROM p LEFT JOIN qu USING (src, shard) LEFT JOIN parts USING (src, shard, start)
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


@query("op8_sharding")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


@query("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# All pairs; the search behind the query is audited to find nearly all of them.
@query("op11_embedding_near_dedup", """
WITH RECURSIVE u AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(CAST(x AS DOUBLE)))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach(vec_id, r) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, p.b FROM reach JOIN p ON p.a = reach.r),
n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(any_value(n), 0) AS n_links, min(r) AS component_id, vec_id = min(r) AS kept
FROM reach LEFT JOIN n USING (vec_id) GROUP BY vec_id
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))[0]


def _clusters_sql(k: int = 40, rounds: int = 5) -> str:
    parts = [r"""
kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(CAST(x AS DOUBLE)))) = 64)""", f"""
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v
  FROM (SELECT sha256('2:' || vec_id) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}))"""]
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, v, d, c FROM (
    SELECT vec_id, v, d, c, row_number() OVER (PARTITION BY vec_id, v ORDER BY d, c) AS place FROM (
      SELECT vec_id, kept.v AS v, c, CAST(list_sum(list_transform(list_zip(kept.v, c{r}.v),
        lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept, c{r}))
  WHERE place = 1)""")
        if r < rounds:
            parts.append(f"""
m{r} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY c, i),
f{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM m{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(f{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN f{r} USING (c))""")
    return "WITH " + ",".join(parts) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance,
       CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)
"""


@query("op12_centroid_clustering", _clusters_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


@query("op13_spelling_variants", rf"""
WITH RECURSIVE
-- CRC-32 by its table of 256 remainders.
crc(i, step, r) AS (
  SELECT range, 0, range FROM range(256) UNION ALL
  SELECT i, step + 1, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END FROM crc WHERE step < 8),
tab AS (SELECT list(r ORDER BY i) AS t FROM crc WHERE step = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), 'null') AS doc, run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all({LOWER_SQL}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL),
bs AS (
  SELECT doc, run, c, flatten(list_transform(string_split(doc || ':' || run, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END)) AS b
  FROM runs),
h AS (
  SELECT doc, run, c, xor(list_reduce(b, lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]), 4294967295::BIGINT), 4294967295) AS h
  FROM (SELECT doc, run, c, CAST(b AS BIGINT[]) AS b, t FROM bs, tab)),
w AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM h),
n AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cut AS MATERIALIZED (SELECT word, i, word[:i - 1] || word[i + 1:] AS rest FROM n, unnest(range(1, length(word) + 1)) t(i)),
near AS (
  SELECT DISTINCT a.word AS word, b.word AS near FROM cut a JOIN cut b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT cut.word, n.word FROM cut JOIN n ON n.word = cut.rest
  UNION SELECT n.word, cut.word FROM cut JOIN n ON n.word = cut.rest),
best AS (
  SELECT near.word, near AS form, m.n AS form_n, count(*) OVER (PARTITION BY near.word) AS n_near,
         row_number() OVER (PARTITION BY near.word ORDER BY m.n DESC, encode(near)) AS place
  FROM near JOIN n m ON m.word = near.near),
f AS MATERIALIZED (
  SELECT n.word, n.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n.n THEN form END AS form,
         CASE WHEN form_n >= 2 * n.n THEN form_n END AS form_n
  FROM n LEFT JOIN best ON best.word = n.word AND place = 1),
chain(word, root) AS (
  SELECT word, word FROM f UNION ALL
  SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, root, f.n, f.n_near, f.form_n
FROM f JOIN (SELECT chain.word, root FROM chain JOIN f ON f.word = root WHERE f.form IS NULL) r ON r.word = f.word
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
