"""Queries over the frame table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames as op
from .registry import query
from .tables import FRAMES_SQL, frames, table

WITH = "WITH " + FRAMES_SQL


@query("frames_current", WITH + "SELECT doc_id, frame_id, pillar, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, len(content)::INTEGER AS n FROM frames WHERE status = 'active'")
def frames_current(spark, sf_dir):
    return op.current(frames(spark, sf_dir)).select("doc_id", "frame_id", "pillar", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.length("content").alias("n"))


@query("active_frames", WITH + "SELECT doc_id FROM frames WHERE status = 'active'")
def active_frames(spark, sf_dir):
    return op.current(frames(spark, sf_dir)).select("doc_id")


@query("all_frames", WITH + "SELECT frame_id, doc_id, status FROM frames")
def all_frames(spark, sf_dir):
    return frames(spark, sf_dir).select("frame_id", "doc_id", "status")


@query("get_doc", WITH + "SELECT doc_id, frame_id, status, content FROM frames WHERE doc_id = 'conv_14'")
def get_doc(spark, sf_dir):
    return frames(spark, sf_dir).filter("doc_id = 'conv_14'").select("doc_id", "frame_id", "status", "content")


@query("get_frame", WITH + "SELECT doc_id, frame_id, status FROM frames WHERE frame_id = 14680065")
def get_frame(spark, sf_dir):
    return frames(spark, sf_dir).filter("frame_id = 14680065").select("doc_id", "frame_id", "status")


@query(
    "lineage",
    WITH + """SELECT doc_id, frame_id, (row_number() OVER w)::INTEGER AS version, lag(frame_id) OVER w AS previous_id, lead(frame_id) OVER w AS next_id
    FROM frames WINDOW w AS (PARTITION BY doc_id ORDER BY created_at, frame_id)""",
)
def lineage(spark, sf_dir):
    return op.lineage(frames(spark, sf_dir)).select("doc_id", "frame_id", "version", "previous_id", "next_id")


HELD = "len(list_filter(tags, lambda t: t = 'legal_hold' OR starts_with(t, 'legal_hold:'))) > 0"


@query("drop_tombstones", WITH + f"SELECT frame_id, CASE WHEN status = 'tombstone' AND NOT ({HELD}) THEN 'deleted' ELSE status END AS status FROM frames")
def drop_tombstones(spark, sf_dir):
    return op.drop_tombstones(frames(spark, sf_dir)).select("frame_id", "status")


@query(
    "retention_keep_n",
    WITH + f"""SELECT frame_id, CASE WHEN status = 'tombstone' AND row_number() OVER (PARTITION BY doc_id, status ORDER BY created_at DESC, frame_id DESC) > 2
    AND NOT ({HELD}) THEN 'deleted' ELSE status END AS status FROM frames""",
)
def retention_keep_n(spark, sf_dir):
    return op.drop_tombstones_keep(frames(spark, sf_dir), 2).select("frame_id", "status")


@query("delete_by_age", WITH + "SELECT frame_id FROM frames WHERE status = 'active' AND created_at < TIMESTAMP '2024-02-01' AND list_contains(tags, 'role:assistant')")
def delete_by_age(spark, sf_dir):
    return op.deletable_by_age(frames(spark, sf_dir), "2024-02-01", "role:assistant").select("frame_id")


@query("delete_docs", WITH + "SELECT frame_id, CASE WHEN status = 'active' AND conv_id IN (3, 5) THEN 'tombstone' ELSE status END AS status FROM frames")
def delete_docs(spark, sf_dir):
    named = spark.createDataFrame([("conv_3",), ("conv_5",)], "doc_id string")
    return op.delete(frames(spark, sf_dir), named).select("frame_id", "status")


@query(
    "restore_latest",
    WITH + """, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, status ORDER BY created_at DESC, frame_id DESC) AS k,
      max((status = 'tombstone')::INTEGER) OVER (PARTITION BY doc_id) AS has FROM frames)
    SELECT frame_id, CASE WHEN status = 'tombstone' AND k = 1 THEN 'active' WHEN status = 'active' AND has = 1 THEN 'tombstone' ELSE status END AS status FROM r""",
)
def restore_latest(spark, sf_dir):
    return op.restore_latest(frames(spark, sf_dir)).select("frame_id", "status")


@query(
    "checkout_version",
    WITH + """, a AS (SELECT frame_id, doc_id, created_at FROM frames UNION ALL SELECT 999999999999, doc_id, TIMESTAMP '2030-01-01' FROM frames WHERE frame_id = 14680064)
    SELECT frame_id, doc_id, CASE WHEN lead(frame_id) OVER (PARTITION BY doc_id ORDER BY created_at, frame_id) IS NULL THEN 'active' ELSE 'tombstone' END AS status FROM a""",
)
def checkout_version(spark, sf_dir):
    return op.checkout(frames(spark, sf_dir), 14680064, 999999999999, "2030-01-01").select("frame_id", "doc_id", "status")


@query("legal_hold_add", WITH + "SELECT frame_id, conv_id = 4 OR conv_id % 7 = 0 AS held FROM frames")
def legal_hold_add(spark, sf_dir):
    return op.hold(frames(spark, sf_dir), "conv_4", "c9").select("frame_id", op.under_legal_hold(F.col("tags")).alias("held"))


@query("legal_hold_release", WITH + "SELECT frame_id, conv_id % 7 = 0 AND conv_id <> 14 AS held, len(tags) - (conv_id = 14)::INTEGER AS n_tags FROM frames")
def legal_hold_release(spark, sf_dir):
    """A hold that is there, and one of a case that is not: that changes nothing."""
    rows = op.release(op.release(frames(spark, sf_dir), "conv_14", "c1"), "conv_7", "other")
    return rows.select("frame_id", op.under_legal_hold(F.col("tags")).alias("held"), F.size("tags").cast("long").alias("n_tags"))


@query("set_pillar", WITH + "SELECT frame_id, CASE WHEN frame_id = 1048576 THEN 'external' ELSE pillar END AS pillar FROM frames")
def set_pillar(spark, sf_dir):
    return op.set_pillar(frames(spark, sf_dir), 1048576, "external").select("frame_id", "pillar")


@query("aes_roundtrip", WITH + "SELECT frame_id, content FROM frames")
def aes_roundtrip(spark, sf_dir):
    key = "0123456789abcdef0123456789abcdef"
    return op.decrypted(op.encrypted(frames(spark, sf_dir), key), key).select("frame_id", "content")


@query("checksum_verify", WITH + "SELECT frame_id, frame_id % 5 <> 0 AS ok FROM frames")
def checksum_verify(spark, sf_dir):
    broken = F.when(F.col("frame_id") % 5 == 0, "x").otherwise(F.sha2("content", 256))
    return op.verified(frames(spark, sf_dir).withColumn("checksum", broken)).select("frame_id", "ok")


@query("sync_orphans", "SELECT 'doc' || (doc_id % 50) || '::' || doc_id AS doc_id FROM documents WHERE doc_id % 50 % 3 <> 0")
def sync_orphans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    file = F.concat(F.lit("doc"), (F.col("doc_id") % 50).cast("string"))
    rows = docs.select(F.concat(file, F.lit("::"), F.col("doc_id").cast("string")).alias("doc_id"), F.lit("active").alias("status"))
    files = spark.range(0, 50, 3).select(F.concat(F.lit("doc"), F.col("id").cast("string")).alias("file"))
    return op.orphans(rows, files).select("doc_id")


@query("ingest_antijoin", "SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL)")
def ingest_antijoin(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    stored = docs.filter("doc_id % 2 = 0").select(F.col("text").alias("content"))
    return op.not_ingested(docs, stored).select("doc_id")


@query("filter_tag", WITH + "SELECT frame_id FROM frames WHERE status = 'active' AND list_contains(tags, 'role:user')")
def filter_tag(spark, sf_dir):
    return op.with_all_tags(frames(spark, sf_dir), ["role:user"]).select("frame_id")


@query("tag_scope_and", WITH + "SELECT frame_id FROM frames WHERE status = 'active' AND list_contains(tags, 'role:user') AND list_contains(tags, 'legal_hold:c1')")
def tag_scope_and(spark, sf_dir):
    return op.with_all_tags(frames(spark, sf_dir), ["role:user", "legal_hold:c1"]).select("frame_id")


@query("scope_filter", WITH + "SELECT frame_id FROM frames WHERE pillar IN ('semantic', 'procedural')")
def scope_filter(spark, sf_dir):
    return frames(spark, sf_dir).filter(F.col("pillar").isin("semantic", "procedural")).select("frame_id")


@query("project_scope", WITH + "SELECT frame_id FROM frames WHERE conv_id % 3 <> 0 OR conv_id % 2 = 0")
def project_scope(spark, sf_dir):
    tag = F.when(F.col("conv_id") % 3 == 0, F.when(F.col("conv_id") % 2 == 0, "project:a").otherwise("project:b"))
    tagged = frames(spark, sf_dir).withColumn("tags", F.array_compact(F.array_append("tags", tag)))
    return op.in_project(tagged, "a").select("frame_id")


@query("tag_counts", WITH + "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM frames WHERE status = 'active') GROUP BY tag")
def tag_counts(spark, sf_dir):
    return op.tag_counts(frames(spark, sf_dir))


@query("distinct_sources", "SELECT DISTINCT source FROM documents WHERE source IS NOT NULL")
def distinct_sources(spark, sf_dir):
    tags = table(spark, sf_dir, "documents").select(F.array(F.concat(F.lit("source:"), "source")).alias("tags"))
    tag = tags.select(F.explode("tags").alias("tag")).filter(F.col("tag").startswith("source:"))
    return tag.select(F.substring("tag", 8, 1 << 30).alias("source")).distinct()


@query(
    "store_stats",
    WITH + """SELECT count(*) AS frames, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'tombstone') AS tombstones,
    sum(strlen(content))::BIGINT AS bytes, coalesce(sum(strlen(content)) FILTER (WHERE status = 'tombstone'), 0)::BIGINT AS tombstone_bytes FROM frames""",
)
def store_stats(spark, sf_dir):
    return op.store_stats(frames(spark, sf_dir))


@query("tombstone_stats", WITH + "SELECT doc_id, count(*) AS n, sum(strlen(content))::BIGINT AS bytes FROM frames WHERE status = 'tombstone' GROUP BY doc_id")
def tombstone_stats(spark, sf_dir):
    gone = frames(spark, sf_dir).filter("status = 'tombstone'")
    return gone.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("content").cast("long")).alias("bytes"))


@query("group_segments", "SELECT 'doc' || (doc_id % 50) AS base, min_by(source, 'doc' || (doc_id % 50) || '::' || doc_id) AS title, count(*) AS n_segments FROM documents GROUP BY 1")
def group_segments(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.format_string("doc%d::%d", F.col("doc_id") % 50, "doc_id").alias("doc_id"), F.col("source").alias("title"))
    return op.segments(rows)


@query("latest_per_key", WITH + "SELECT doc_id, max_by(content, turn) AS content, count(*) AS n FROM frames GROUP BY doc_id")
def latest_per_key(spark, sf_dir):
    return op.latest_per_key(frames(spark, sf_dir), "doc_id", "content", "created_at", "frame_id")


@query(
    "audit_chain",
    WITH.replace("WITH", "WITH RECURSIVE", 1) + """, n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY turn) AS seq, doc_id || '|' || frame_id || '|' || pillar AS line FROM frames),
    h AS (SELECT doc_id, seq, sha256('|' || line) AS hash FROM n WHERE seq = 1
          UNION ALL SELECT n.doc_id, n.seq, sha256(h.hash || '|' || n.line) FROM h JOIN n ON n.doc_id = h.doc_id AND n.seq = h.seq + 1)
    SELECT doc_id, seq, hash FROM h""",
)
def audit_chain(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumn("seq", F.row_number().over(op._versions()).cast("long"))
    return op.chained(rows, "doc_id", "doc_id", "frame_id", "pillar")


@query("audit_verify", WITH + ", n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY turn) AS seq FROM frames) SELECT doc_id, seq FROM n WHERE seq IN (2, 3)")
def audit_verify(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumn("seq", F.row_number().over(op._versions()).cast("long"))
    hashes = op.chained(rows, "doc_id", "doc_id", "frame_id", "pillar")
    forged = hashes.withColumn("hash", F.when(F.col("seq") == 2, F.sha2("hash", 256)).otherwise(F.col("hash")))
    stored = rows.select("doc_id", "seq", "frame_id", "pillar").join(forged, ["doc_id", "seq"])
    return op.chain_breaks(stored, "doc_id", "doc_id", "frame_id", "pillar").select("doc_id", "seq")


@query("who_deleted", WITH + "SELECT f.frame_id, e.event_id, e.user_id FROM frames f JOIN events e ON e.event_type = 'error' AND e.event_id % 1000 = f.conv_id WHERE f.status = 'tombstone'")
def who_deleted(spark, sf_dir):
    audit = table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", "user_id", F.concat(F.lit("conv_"), (F.col("event_id") % 1000).cast("string")).alias("doc_id"))
    return frames(spark, sf_dir).filter("status = 'tombstone'").join(audit, "doc_id").select("frame_id", "event_id", "user_id")


@query("recall_by_pillar", WITH + "SELECT frame_id, len(content)::INTEGER AS score FROM frames WHERE status = 'active' AND pillar = 'semantic' ORDER BY score DESC, frame_id LIMIT 20")
def recall_by_pillar(spark, sf_dir):
    found = op.current(frames(spark, sf_dir)).filter("pillar = 'semantic'").select("frame_id", F.length("content").alias("score"))
    return found.orderBy(F.col("score").desc(), "frame_id").limit(20)


@query("scope_semi", WITH + "SELECT frame_id FROM frames WHERE doc_id IN (SELECT 'conv_' || user_id FROM events WHERE event_type = 'view')")
def scope_semi(spark, sf_dir):
    scope = table(spark, sf_dir, "events").filter("event_type = 'view'").select(F.concat(F.lit("conv_"), F.col("user_id").cast("string")).alias("doc_id"))
    return frames(spark, sf_dir).join(scope, "doc_id", "left_semi").select("frame_id")


@query("lens_view", WITH + "SELECT frame_id FROM frames WHERE status = 'active' AND doc_id IN ('conv_1', 'conv_2', 'conv_7') AND list_contains(tags, 'role:assistant')")
def lens_view(spark, sf_dir):
    ids = spark.createDataFrame([("conv_1",), ("conv_2",), ("conv_7",)], "doc_id string")
    return op.with_all_tags(frames(spark, sf_dir).join(ids, "doc_id", "left_semi"), ["role:assistant"]).select("frame_id")


@query("parse_tag", WITH + "SELECT frame_id, split_part(t, ':', 1) AS ns, split_part(t, ':', 2) AS value FROM (SELECT frame_id, unnest(tags) AS t FROM frames)")
def parse_tag(spark, sf_dir):
    tags = frames(spark, sf_dir).select("frame_id", F.explode("tags").alias("t"))
    return tags.select("frame_id", F.split_part("t", F.lit(":"), F.lit(1)).alias("ns"), F.split_part("t", F.lit(":"), F.lit(2)).alias("value"))


@query("memory_manifest", WITH + r"SELECT doc_id, left(regexp_replace(content, '[\x20\x09-\x0D]+', ' ', 'g'), 80) AS line FROM frames WHERE status = 'active' AND pillar = 'semantic'")
def memory_manifest(spark, sf_dir):
    line = F.substring(F.regexp_replace("content", r"[\x20\x09-\x0D]+", " "), 1, 80).alias("line")
    return op.current(frames(spark, sf_dir)).filter("pillar = 'semantic'").select("doc_id", line)


@query(
    "remember_with_pillar",
    WITH + """ SELECT pillar, CASE pillar WHEN 'semantic' THEN 'factual' ELSE pillar END AS memory_type, CASE pillar WHEN 'episodic' THEN 'ep' WHEN 'semantic' THEN 'sem' ELSE 'proc' END AS prefix,
    count(*) AS n, count(*) AS n_ids, count(*) AS n_tagged FROM frames GROUP BY pillar""",
)
def remember_with_pillar(spark, sf_dir):
    rows = frames(spark, sf_dir)
    new = rows.select(F.lit(None).cast("string").alias("doc_id"), "content", "pillar", "tags")
    found = op.remember_with_pillar(rows, new).withColumn("prefix", F.split_part("doc_id", F.lit("_"), F.lit(1)))
    tagged = F.count_if(F.array_contains("tags", F.concat(F.lit("pillar:"), "pillar")))
    return found.groupBy("pillar", "memory_type", "prefix").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_ids"), tagged.alias("n_tagged"))


@query("binary_round_trip", WITH + " SELECT doc_id, sha256(content) AS hash FROM frames WHERE status = 'active'")
def binary_round_trip(spark, sf_dir):
    rows = frames(spark, sf_dir)
    new = op.put_binary(rows, rows.select("doc_id", F.encode("content", "UTF-8").alias("payload"), "pillar", "tags", "created_at", "status"))
    return op.read_binary(new).select("doc_id", F.sha2("payload", 256).alias("hash"))
