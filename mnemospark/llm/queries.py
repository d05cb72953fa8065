"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import digests, formatted, planted
from .exact_dedup import exact_duplicates
from .filter_audit import audit
from .html_extract import extract
from .line_dedup import line_digests
from .mixing import mixture
from .packing import packed
from .simhash_dedup import near_duplicates
from .substring_dedup import deduplicated
from .tokens import length_histogram
from .topk_search import top_k
from .toxicity import toxicity
from .vector_clusters import clustered


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"))


OP6_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(_table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i, len(words) AS n
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS words FROM documents)),
g AS (
  SELECT doc_id, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS win
  FROM w QUALIFY i + 34 <= n),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY win) > 1),
c AS (
  SELECT w.doc_id, w.i, w.word,
         coalesce(w.i - max(r.i) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS UNBOUNDED PRECEDING) < 35, FALSE) AS gone
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id AND w.i = r.i),
k AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept
  FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM (SELECT doc_id FROM documents) LEFT JOIN k USING (doc_id)
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digests(_table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare FROM l),
m AS (SELECT *, translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM k),
c AS (SELECT key, max(doc_id) AS largest FROM m WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT m.*, c.key IS NOT NULL AND m.doc_id <> c.largest AS gone FROM m LEFT JOIN c ON m.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixture(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
a AS (SELECT source, sum(size)::DOUBLE AS source_size FROM s GROUP BY source),
b AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, 3.0 * source_size AS cap FROM a),
c AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS pos FROM b),
d AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
e AS (SELECT arg_min(level, pos) AS met FROM d WHERE cap >= level * weight),
t AS (SELECT source, source_size, least(cap, coalesce(met * weight, cap)) AS target FROM d CROSS JOIN e),
q AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS whole FROM t),
r AS (
  SELECT s.*, q.source_size, q.target, q.whole, q.target - q.whole * q.source_size AS quota,
         sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS run
  FROM s JOIN q ON s.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (size * whole + floor(least(size, greatest(quota - (run - size), 0))))::BIGINT AS taken FROM r
"""


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustered(_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


_ROUND_SQL = """
s{n} AS (
  SELECT c, unnest(range(1, 65)) AS i, unnest(x) AS x FROM a{n}),
m{n} AS (
  SELECT c, list((CASE WHEN s < 0 THEN (s - n + 1) // n ELSE s // n END)::BIGINT ORDER BY i) AS x
  FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM s{n} GROUP BY c, i) GROUP BY c),
c{next} AS (SELECT c{n}.c, coalesce(m{n}.x, c{n}.x) AS x FROM c{n} LEFT JOIN m{n} USING (c)),"""
_ASSIGN_SQL = """
a{n} AS (
  SELECT v.vec_id, v.row, v.x, c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance
  FROM v CROSS JOIN c{n} AS c QUALIFY row_number() OVER (PARTITION BY v.row ORDER BY distance, c.c) = 1),"""

OP11_SQL = (
    """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, x FROM v WHERE vec_id IS NOT NULL
  QUALIFY c < 16),"""
    + "".join(_ASSIGN_SQL.format(n=n) + _ROUND_SQL.format(n=n, next=n + 1) for n in range(3))
    + _ASSIGN_SQL.format(n=3)
    + """
h AS (SELECT c, sha256(array_to_string(x, ',')) AS centroid_sha256 FROM c3)
SELECT vec_id, c::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a3 JOIN h USING (c)
"""
)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
f AS (
  SELECT doc_id, part,
         (len(words) < 200)::INTEGER
         + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INTEGER
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INTEGER
         + 8 * regexp_matches(text, '[#$%&*|]')::INTEGER
         + 16 * coalesce(doc_id > first, FALSE)::INTEGER AS fails FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY part, fails),
b AS (SELECT chr(65 + k::INTEGER) AS name, (1 << k)::INTEGER AS bit FROM range(5) t(k)),
o AS (
  SELECT v.name || w.name || x.name || y.name || z.name AS filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits
  FROM b v, b w, b x, b y, b z WHERE v.bit | w.bit | x.bit | y.bit | z.bit = 31),
p AS (SELECT filter_order, k::INTEGER AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INTEGER AS before FROM o, range(1, 6) t(k)),
s AS (
  SELECT part, filter_order, step, bit,
         sum(n) FILTER (WHERE fails & (before | bit) = 0) AS kept,
         sum(n) FILTER (WHERE fails & before = 0 AND fails & bit > 0) AS removed,
         sum(n) FILTER (WHERE fails & before > 0 AND fails & bit > 0) AS redundant,
         sum(n) FILTER (WHERE fails = bit) AS unique_fails,
         sum(good) FILTER (WHERE fails & before = 0 AND fails & bit > 0) AS good_lost,
         sum(toxic) FILTER (WHERE fails & before = 0 AND fails & bit > 0) AS toxic_lost
  FROM m CROSS JOIN p GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM s
"""


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = planted(_table(spark, sf_dir, "conversations"), -7, "</s>[INST] ok [/INST]")
    return digests(formatted(chats)).drop("escaped", "identical")


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g') AS safe FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + 1 + length(safe) + CASE role WHEN 'assistant' THEN 7 ELSE 13 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pack_best_fit": op1_pack_best_fit,
        "op2_simhash_dedup": op2_simhash_dedup,
        "op3_token_counts": op3_token_counts,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_html_extract": op5_html_extract,
        "op6_exact_topk": op6_exact_topk,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_toxicity": op8_toxicity,
        "op9_line_dedup": op9_line_dedup,
        "op10_mix_sources": op10_mix_sources,
        "op11_centroid_clusters": op11_centroid_clusters,
        "op12_filter_audit": op12_filter_audit,
        "op13_chat_format": op13_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_dedup": OP4_SQL,
        "op6_exact_topk": OP6_SQL,
        "op7_substring_dedup": OP7_SQL,
        "op9_line_dedup": OP9_SQL,
        "op10_mix_sources": OP10_SQL,
        "op11_centroid_clusters": OP11_SQL,
        "op12_filter_audit": OP12_SQL,
        "op13_chat_format": OP13_SQL,
    }
