"""Queries through the sources, over rows as their readers give them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files as S
from .registry import query
from .tables import table


@query("text_frames", """
WITH s AS (SELECT doc_id, text, greatest(0, ceil((length(text) - 512) / 256.0))::BIGINT AS last FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, text, unnest(range(0, last + 1)) AS i FROM s),
c AS (SELECT doc_id, i, substr(text, i * 256 + 1, 512) AS part FROM w)
SELECT 'f' || doc_id || '.txt::para_' || i AS doc_id, sha256(part) AS checksum FROM c WHERE strlen(trim(part, ' ')) >= 50""")
def text_frames(spark, sf_dir):
    files = table(spark, sf_dir, "documents").filter("text is not null").select(F.format_string("/in/f%d.txt", "doc_id").alias("file"), "text")
    return S.text_frames(files).filter(F.octet_length(F.trim("content")) >= 50).select("doc_id", "checksum")


@query("mem0_import", "SELECT 'm' || conv_id || '_' || turn AS doc_id, CASE role WHEN 'system' THEN 'procedural' WHEN 'user' THEN 'episodic' ELSE 'semantic' END AS pillar FROM conversations")
def mem0_import(spark, sf_dir):
    kind = F.when(F.col("role") == "system", "Skill").when(F.col("role") == "user", "event")
    rows = table(spark, sf_dir, "conversations").select(F.format_string("m%d_%d", "conv_id", "turn").alias("id"), F.col("text").alias("memory"), F.col("conv_id").cast("string").alias("user_id"), F.lit("2024-01-01").alias("created_at"), F.array_compact(F.array(kind)).alias("categories"))
    return S.mem0_frames(rows).select("doc_id", "pillar")


@query("memvid_import", "SELECT 'v' || event_id AS doc_id, 'type:' || event_type AS tag FROM events")
def memvid_import(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.format_string("v%d", "event_id").alias("id"), F.col("props").alias("content"), F.lit(1704067200).alias("timestamp"), F.create_map(F.lit("type"), "event_type").alias("metadata"))
    return S.memvid_frames(rows).select("doc_id", F.element_at("tags", 1).alias("tag"))


@query("migration_counts", "SELECT CASE role WHEN 'system' THEN 'procedural' WHEN 'user' THEN 'episodic' ELSE 'semantic' END AS pillar, count(*) AS n FROM conversations GROUP BY 1")
def migration_counts(spark, sf_dir):
    kind = F.when(F.col("role") == "system", "Skill").when(F.col("role") == "user", "event")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("text").alias("memory"), F.lit("u").alias("user_id"), F.lit("2024-01-01").alias("created_at"), F.array_compact(F.array(kind)).alias("categories"))
    return S.migrated(S.mem0_frames(rows))[1]


@query("browser_pointers", r"SELECT substr(sha256(url), 1, 16) AS doc_id, 'page — ' || regexp_extract(url, '^https?://([^/?#:]+)', 1) AS content FROM (SELECT url FROM pages WHERE url IS NOT NULL AND page_id % 4 >= 2 ORDER BY page_id DESC, url LIMIT 50)")
def browser_pointers(spark, sf_dir):
    visits = table(spark, sf_dir, "pages").filter("url is not null").select("url", F.lit("page").alias("title"), (F.col("page_id") % 4).alias("visit_count"), F.col("page_id").alias("last_visit_time"))
    return S.history_frames(visits, 2, 50).select("doc_id", "content")


@query("event_frames", "SELECT 'event:' || event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def event_frames(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), F.col("event_type").alias("kind"), "ts", F.col("props").alias("summary"))
    return S.event_frames(rows).groupBy(F.element_at("tags", 1).alias("kind")).agg(F.count("*").alias("n"))


@query("sql_tokenizers", "SELECT n_nationkey, 2 AS n FROM nation")
def sql_tokenizers(spark, sf_dir):
    from ..functions import text as T

    T.register_tokenizers(spark)
    return table(spark, sf_dir, "nation").select("n_nationkey", F.expr("size(name_parts(n_name))").alias("n"))
