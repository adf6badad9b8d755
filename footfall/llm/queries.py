"""The operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall.llm import automata, bpe, language, maxent, mixing, near_dup, pii, quality, run_index, search, simhash, sketch, trie
from footfall.llm.common import documents
from footfall.session import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def vocabulary() -> str:
    """Path of the vocabulary file: FOOTFALL_VOCABULARY or the installed public one."""
    if path := os.environ.get("FOOTFALL_VOCABULARY"):
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# The windows of 9 and 10 and the pairs of 4 are all written out, so these are for small tables.
REPEATED_WORDS = r"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i+12], ' ')) AS h FROM (SELECT r, doc_id, w, unnest(range(1, len(w)-11)) AS i FROM t)),
hit AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY h) AS f FROM win) WHERE f < doc_id),
gone AS (SELECT DISTINCT r, i+k AS p FROM hit, range(0, 13) g(k)),
kept AS (SELECT r, list(w[p] ORDER BY p) AS l FROM (SELECT t.r, w, unnest(range(1, len(w)+1)) AS p FROM t) x WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.r = x.r AND gone.p = x.p) GROUP BY r),
n AS (SELECT r, count(*) AS c FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c, 0) AS n_removed, sha256(coalesce(array_to_string(l, ' '), '')) AS kept_sha256
FROM t LEFT JOIN kept ON kept.r = t.r LEFT JOIN n ON n.r = t.r"""
REPEATED_BYTES = r"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS s, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT r, i, md5_number(substr(x, 2*i+1, 400)) AS h FROM (SELECT r, x, unnest(range(0, CAST(len(x)/2 AS BIGINT)-199)) AS i FROM t)),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS c FROM win) WHERE c > 1),
edge AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i), 1000) AS gap FROM hit),
span AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM (SELECT r, i, sum(CAST(gap > 200 AS INT)) OVER (PARTITION BY r ORDER BY i) AS g FROM edge) GROUP BY r, g),
each AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM span),
per AS (SELECT r, sum(b-a) AS gone, count(*) AS spans, max(b) AS last, list([before, a] ORDER BY a) AS keep FROM each GROUP BY r),
rest AS (SELECT t.r, coalesce(array_to_string([substr(x, 2*k[1]+1, 2*(k[2]-k[1])) for k in keep], ''), '') || substr(x, 2*coalesce(last, 0)+1) AS left_over FROM t LEFT JOIN per ON per.r = t.r)
SELECT doc_id, CAST(len(x)//2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(left_over)) AS kept_sha256
FROM t JOIN rest ON rest.r = t.r LEFT JOIN per ON per.r = t.r"""
NEAR = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i+1] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), CASE WHEN len(w) = 1 THEN 2 ELSE 0 END))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pr AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
e AS (SELECT a, b FROM pr JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100*c >= 80*(p.n + q.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS k, doc_id AS m FROM d UNION SELECT reach.k, u.b FROM reach JOIN u ON u.a = reach.m),
comp AS (SELECT k, min(m) AS component_id FROM reach GROUP BY k)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN comp ON comp.k = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
MIX = r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS o FROM documents),
t AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][k % 3 + 1] AS weight, [-0.5, 0.0, 0.5][k % 3 + 1] AS slope, 2.0*source_size AS cap FROM t),
l AS (SELECT *, (1.5*sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap/weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap/weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT w.*, least(cap, (SELECT level FROM l WHERE level <= cap/weight ORDER BY cap/weight, k LIMIT 1)*weight) AS target FROM w),
p AS (SELECT d.doc_id, d.source, d.size, CAST(source_size AS BIGINT) AS source_size, target, slope, CAST(round(target) AS BIGINT) AS goal,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN g ON g.source IS NOT DISTINCT FROM d.source),
c AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS whole FROM p),
e AS (SELECT *, CAST(whole*size + greatest(0, least(size, goal - whole*source_size - before)) AS BIGINT) AS taken, before/target AS u, slope + 1.0 AS b FROM c)
SELECT doc_id, source, size, source_size, round(target, 6) AS target, taken,
CASE WHEN taken > 0 THEN round(least(1.0, u*2.0/(b + sqrt(greatest(b*b - slope*u*4.0, 0.0)))), 9) END AS position FROM e"""

SEARCH = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
g AS (SELECT count(*) AS all_docs, CAST(sum(len(t)) AS BIGINT) AS all_terms FROM d WHERE len(t) > 0),
q AS (SELECT row_number() OVER () AS i, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
qt AS (SELECT i, unnest(t) AS term FROM q),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000*ln((2.0*all_docs+2)/(2.0*count(*)+1))) AS BIGINT) AS w FROM p, g GROUP BY term, all_docs),
s AS (SELECT i, r, CAST(sum(w*((1000000000*tf)//(1000*tf+20*(50+(50*CAST(len(t) AS BIGINT)*all_docs)//all_terms)))) AS BIGINT) AS score
  FROM qt JOIN p ON p.term = qt.term JOIN w ON w.term = p.term JOIN d USING (r), g GROUP BY i, r),
k AS (SELECT q.item_id, CAST(row_number() OVER (PARTITION BY s.i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s JOIN q ON q.i = s.i JOIN d ON d.r = s.r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50"""
CRC32 = """list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda crc, x: list_reduce([xor(crc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))"""
TRIE = f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS o,
  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor({CRC32.format("conv_id")}, 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
s AS (SELECT c.conv_id, 0 AS part, o, role, text FROM c JOIN t ON t.conv_id = base WHERE o < h UNION ALL SELECT c.conv_id, 1, o, role, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE o >= h),
l AS (SELECT conv_id, list([role, text] ORDER BY part, o) AS l FROM s GROUP BY conv_id),
p AS (SELECT conv_id, d, len(l) = d AS ends, sha256(CAST(l[1:d] AS VARCHAR) || CAST(list_transform(l[1:d], lambda x: len(x[1])*1000003 + len(x[2])) AS VARCHAR)) AS name, CASE WHEN d > 0 THEN length(l[d][2]) ELSE 0 END AS chars
  FROM (SELECT c.conv_id, coalesce(l.l, []) AS l, unnest(range(0, coalesce(len(l.l), 0) + 1)) AS d FROM c LEFT JOIN l ON l.conv_id = c.conv_id)),
n AS (SELECT d, name, min(conv_id) AS conv_id, count(*) AS n, max(chars) AS chars,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY d, name),
m AS (SELECT p.conv_id, p.d, n.conv_id AS node, n.n, n.chars FROM p JOIN n ON n.d = p.d AND n.name = p.name),
f AS (SELECT DISTINCT x.node AS top, x.d AS top_d, y.node, y.d, y.n, y.chars FROM m x JOIN m y ON y.conv_id = x.conv_id AND y.d >= x.d),
kids AS (SELECT top, top_d, count(*) AS k FROM f WHERE d = top_d + 1 GROUP BY top, top_d),
totals AS (SELECT f.top, f.top_d, count(*) FILTER (kids.k IS NULL) AS leaves, sum((f.n-1)*f.chars) AS saved FROM f LEFT JOIN kids ON kids.top = f.node AND kids.top_d = f.d GROUP BY f.top, f.top_d)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, above.node AS parent_conv_id, n.n AS n_convs, coalesce(kids.k, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM n JOIN totals ON totals.top = n.conv_id AND totals.top_d = n.d LEFT JOIN kids ON kids.top = n.conv_id AND kids.top_d = n.d LEFT JOIN m above ON above.conv_id = n.conv_id AND above.d = n.d - 1"""


@query("op7_bpe_forced_boundary")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(documents(spark, sf_dir), vocabulary())


@query("op8_curriculum_mix", MIX)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = mixing.sized(documents(spark, sf_dir).select("doc_id", "source", "text")).drop("text")
    plan = mixing.curriculum(materialize(sizes, "mix-sizes"))
    first = F.round(F.try_element_at("positions", F.lit(1)), 9).alias("position")
    out = plan.select("doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"), "taken", first)
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


@query("op3_line_frequency")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).drop("source", "_removed")


@query("op5_language_ftrl")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", language.held_out(F.col("doc_id"), 3, 1))
    model = language.train(docs.where("NOT held_out"))
    return language.predict(docs.select("doc_id", "held_out", "text"), model)


@query("op1_pii_weak_supervision")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(documents(spark, sf_dir).select("doc_id", "text"), keep_text=False)
    counts = [pii.count_of("base_spans", kind).alias(f"n_{kind}") for kind in pii.KINDS[: pii.BASE]]
    return found.select("doc_id", *counts, F.sha2(pii.spelled(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), pii.spelled(F.col("spans")).alias("spans"))


@query("op6_threshold_sketch")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = sketch.edited_pairs(documents(spark, sf_dir))
    return pairs.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sketch.spelled(F.col("_sketch")).alias("fingerprint"), sketch.spelled(F.col("_edited_sketch")).alias("edited_fingerprint"),
        sketch.containment(F.col("_sketch"), F.col("_edited_sketch")).alias("near_edited"),
        sketch.containment(F.col("_sketch"), F.col("_next_sketch")).alias("near_next"),
    )


@query("op9_suffix_automata", REPEATED_WORDS)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automata.removal_digests(documents(spark, sf_dir))


@query("op10_run_length_index", REPEATED_BYTES)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_index.removal_digests(documents(spark, sf_dir))


@query("op4_coordinate_join", NEAR)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir))


@query("op2_hashed_maxent")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_texts(documents(spark, sf_dir))


@query("op11_hybrid_search", SEARCH)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(search.index(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op12_prefix_trie", TRIE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query("op13_pigeonhole_simhash")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))
