"""Queries over vault, access and catalogue tables; where the driver has no such table, it is
made from one that has the shape, or given as a few rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as op
from ..sources import files
from .registry import query
from .tables import FRAMES_SQL, frames, table

WITH = "WITH " + FRAMES_SQL


@query("acl_filter", WITH + "SELECT frame_id FROM frames WHERE list_contains(tags, 'role:user') OR (NOT list_contains(tags, 'legal_hold:c1') AND turn % 2 = 1)")
def acl_filter(spark, sf_dir):
    docs = frames(spark, sf_dir).withColumn("doc_id", F.col("frame_id")).withColumn("tags", F.when(F.col("turn") % 2 == 1, F.array_append("tags", F.lit("odd"))).otherwise(F.col("tags")))
    roles = spark.createDataFrame(
        [("reader", ["role:user"], ["none"], ["read"]), ("odd", ["odd"], ["legal_hold:c1"], ["read", "write"]), ("writer", ["*"], [], ["write"])],
        "role string, allows array<string>, denies array<string>, operations array<string>",
    )
    return op.allowed(docs, roles, "read").select("frame_id")


@query("retention_deletable", "SELECT o_orderkey AS doc_id, NOT (o_orderstatus = 'O' OR o_orderdate > TIMESTAMP '1996-01-01') AS deletable FROM orders")
def retention_deletable(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("disposition_at"), (F.col("o_orderstatus") == "O").alias("legal_hold"))
    return op.deletable(orders, orders, F.lit("1996-01-01").cast("timestamp"))


@query("app_grants", "SELECT event_id FROM events WHERE (user_id % 10 = 1 AND event_type = 'view') OR (user_id % 10 = 2 AND event_type = 'click')")
def app_grants(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 10).alias("app_id"), F.col("event_type").alias("action"))
    return op.granted(calls, spark.createDataFrame([(1, "view"), (2, "click")], "app_id long, action string")).select("event_id")


@query("enterprise_guard", WITH + "SELECT pillar, count(*) AS n FROM frames WHERE pillar = 'procedural' GROUP BY pillar")
def enterprise_guard(spark, sf_dir):
    return frames(spark, sf_dir).filter("pillar = 'procedural'").groupBy("pillar").agg(F.count("*").alias("n"))


PARTS_SQL = "parts AS (SELECT doc_id, frame_id, CASE WHEN turn % 2 = 0 THEN 'paragraph' ELSE 'note' END AS kind, turn AS pos, content FROM frames)"


def parts(spark, sf_dir):
    return frames(spark, sf_dir).select("doc_id", F.when(F.col("turn") % 2 == 0, "paragraph").otherwise("note").alias("kind"), F.col("turn").alias("pos"), "content")


@query("asset_dedup", WITH + "," + PARTS_SQL + " SELECT DISTINCT kind, sha256(content) AS hash FROM parts")
def asset_dedup(spark, sf_dir):
    return op.assets(parts(spark, sf_dir)).select("kind", "hash")


@query("object_get", WITH + "," + PARTS_SQL + """, a AS (SELECT kind, sha256(content) AS hash, any_value(content) AS content FROM parts GROUP BY ALL),
    q AS (SELECT kind, hash FROM a UNION ALL SELECT 'other', hash FROM a) SELECT q.kind, q.hash, a.hash IS NOT NULL AS found, md5(content) AS content FROM q LEFT JOIN a ON q.kind = a.kind AND q.hash = a.hash""")
def object_get(spark, sf_dir):
    """Every object asked for under its own kind and under another."""
    have = op.assets(parts(spark, sf_dir))
    asked = have.select("kind", "hash").union(have.select(F.lit("other"), "hash"))
    return op.objects(have, asked).select("kind", "hash", "found", F.md5("content").alias("content"))


@query("object_count", WITH + "," + PARTS_SQL + " SELECT kind, count(*) AS n, sum(strlen(content))::BIGINT AS size FROM (SELECT DISTINCT kind, content FROM parts) GROUP BY 1")
def object_count(spark, sf_dir):
    return op.object_counts(op.assets(parts(spark, sf_dir)))


@query("manifest_rebuild", WITH + "," + PARTS_SQL + " SELECT doc_id, string_agg(content, chr(10) ORDER BY pos) AS content FROM parts GROUP BY doc_id")
def manifest_rebuild(spark, sf_dir):
    p = parts(spark, sf_dir)
    return op.rebuilt(op.manifests(p), op.assets(p))


@query("unshared_assets", WITH + "," + PARTS_SQL + " SELECT DISTINCT kind, sha256(content) AS hash FROM parts p WHERE doc_id = 'conv_1' AND NOT EXISTS (SELECT 1 FROM parts o WHERE o.doc_id <> 'conv_1' AND o.kind = p.kind AND o.content = p.content)")
def unshared_assets(spark, sf_dir):
    return op.unshared(op.manifests(parts(spark, sf_dir)), "conv_1")


@query("delete_certificate", WITH + " SELECT frame_id, sha256(doc_id || '|' || frame_id || '|' || pillar) AS seal FROM frames WHERE status = 'tombstone'")
def delete_certificate(spark, sf_dir):
    return op.seal(frames(spark, sf_dir).filter("status = 'tombstone'"), "doc_id", "frame_id", "pillar").select("frame_id", "seal")


@query("code_range", "SELECT s_suppkey AS code FROM supplier WHERE NOT (s_nationkey < 10 AND s_suppkey BETWEEN 1 AND 50) AND NOT (s_nationkey >= 10 AND s_suppkey BETWEEN 40 AND 80)")
def code_range(spark, sf_dir):
    codes = table(spark, sf_dir, "supplier").select(F.when(F.col("s_nationkey") < 10, "a").otherwise("b").alias("module"), F.col("s_suppkey").alias("code"))
    return op.outside_ranges(codes, spark.createDataFrame([("a", 1, 50), ("b", 40, 80)], "module string, low long, high long")).select("code")


@query("full_outer_conflict", "SELECT key, CASE WHEN b IS NULL THEN 'primary only' WHEN a IS NULL THEN 'secondary only' ELSE 'differs' END AS state FROM (SELECT p_partkey AS key, p_size AS a FROM part WHERE p_partkey % 3 <> 0) FULL JOIN (SELECT p_partkey AS key, p_size - (p_partkey % 2)::INTEGER AS b FROM part WHERE p_partkey % 4 <> 0) USING (key) WHERE a IS DISTINCT FROM b")
def full_outer_conflict(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    a = part.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("v"))
    b = part.filter("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("key"), (F.col("p_size") - (F.col("p_partkey") % 2).cast("int")).alias("v"))
    return op.conflicts(a, b, "key", "v")


#: Part names as tables: the first word is the schema, the types are the columns.
PARTS_SQL = """WITH t AS (SELECT min(p_partkey) AS ord, split_part(p_name, ' ', 1) AS schema, replace(p_name, ' ', '_') AS "table", list_distinct(list(p_type)) AS columns FROM part GROUP BY p_name)"""


def _part_tables(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("ord"), F.collect_set("p_type").alias("columns"))
    return rows.select("ord", F.split("p_name", " ")[0].alias("schema"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("table"), "columns")


@query(
    "borrow_best",
    PARTS_SQL
    + """, e AS (SELECT entity, list_distinct(list(p_type)) AS fields FROM (SELECT split_part(p_name, ' ', 1) AS entity, p_type FROM part UNION ALL SELECT split_part(p_name, ' ', 2), p_type FROM part) GROUP BY entity),
    b AS (SELECT entity, "table", ord, lower(entity) AS n, replace(lower("table"), '_', '') AS tn, lower(schema) AS sn,
      list_transform(fields, lambda x: replace(lower(x), '_', '')) AS fields, list_transform(columns, lambda x: replace(lower(x), '_', '')) AS columns FROM e, t),
    s AS (SELECT entity, "table", ord, CASE WHEN contains(tn, n) THEN 50 ELSE 0 END + CASE WHEN sn = n THEN 80 WHEN contains(sn, n) OR contains(n, sn) THEN 40 ELSE 0 END
      + 10 * len(list_filter(fields, lambda f: len(list_filter(columns, lambda c: contains(c, f) OR contains(f, c))) > 0)) AS score FROM b)
    SELECT entity, "table", score::INTEGER AS score FROM s WHERE score >= 50 QUALIFY row_number() OVER (PARTITION BY entity ORDER BY score DESC, ord) = 1""",
)
def borrow_best(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("entity"), "p_type")
    return op.borrow(part.groupBy("entity").agg(F.collect_set("p_type").alias("fields")), _part_tables(spark, sf_dir))


@query(
    "table_token_score",
    PARTS_SQL
    + r""", w AS (SELECT p_partkey AS query_id, unnest(regexp_extract_all(lower(p_name || ' ' || p_type || 's'), '[a-z0-9]+')) AS w FROM part),
    o AS (SELECT query_id, w, CASE WHEN w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END AS o FROM w WHERE length(w) > 2),
    s AS (SELECT query_id, "table", sum(CASE WHEN contains(lower(schema), o) THEN 3 ELSE 0 END + CASE WHEN contains(lower("table"), o) THEN 2 ELSE 0 END + CASE WHEN contains(lower("table"), w) THEN 1 ELSE 0 END)::BIGINT AS score FROM o, t GROUP BY ALL)
    SELECT query_id, "table", score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, "table")::INTEGER AS rank FROM s WHERE score > 0 QUALIFY rank <= 4""",
)
def table_token_score(spark, sf_dir):
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.concat("p_name", F.lit(" "), "p_type", F.lit("s")).alias("text"))
    return op.token_score(asked, _part_tables(spark, sf_dir))


@query("verdict_pivot", "SELECT o_orderpriority AS key, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def verdict_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_orderstatus").alias("verdict"))
    return op.verdicts(rows, "key", ["F", "O", "P"])


@query("literal_index", "SELECT p_brand AS value, count(*) AS n, min(p_partkey) AS first_line FROM part GROUP BY 1")
def literal_index(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("value"), F.lit("part").alias("file"), F.col("p_partkey").alias("line"))
    return op.literal_index(rows).select("value", "n", F.col("first_at.line").alias("first_line"))


@query("pillar_coverage", WITH + " SELECT p.pillar, count(f.frame_id) AS n FROM (VALUES ('episodic'), ('semantic'), ('procedural'), ('code')) AS p(pillar) LEFT JOIN frames f ON f.pillar = p.pillar GROUP BY 1")
def pillar_coverage(spark, sf_dir):
    domain = spark.createDataFrame([(x,) for x in ("episodic", "semantic", "procedural", "code")], "pillar string")
    return op.pillar_coverage(frames(spark, sf_dir), domain)


@query("originals", WITH + " SELECT doc_id, sha256(max_by(content, turn)) AS hash, strlen(max_by(content, turn))::BIGINT AS size FROM frames GROUP BY doc_id")
def originals(spark, sf_dir):
    store = op.originals(frames(spark, sf_dir).select("doc_id", F.col("turn").alias("seq"), F.encode("content", "UTF-8").alias("payload")))
    back = op.original(store, store.select("doc_id"))
    return back.select("doc_id", F.sha2("payload", 256).alias("hash"), F.octet_length("payload").cast("long").alias("size"))


@query(
    "proc_for_op",
    """WITH o AS (SELECT s_suppkey AS op, CASE s_suppkey % 3 WHEN 0 THEN 'POST' WHEN 1 THEN 'get' END AS method, n_name AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_nationkey <> 3),
    p AS (SELECT 'p_' || n_name AS proc, n_name AS k, n_nationkey % 3 AS kind FROM nation),
    f AS (SELECT op, proc, CASE WHEN method = 'POST' THEN kind = 1 ELSE kind > 0 END AS fits FROM o JOIN p USING (k) WHERE op <> 2)
    SELECT op, proc, CASE WHEN fits THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN fits THEN 'heuristic.proc_method_aligned' ELSE 'heuristic.proc_method_misaligned' END AS rule FROM f
    UNION ALL SELECT s_suppkey, NULL, 'none', 'missing.no_proc_references' FROM supplier WHERE s_nationkey = 3 AND s_suppkey <> 2
    UNION ALL SELECT 2, p, 'explicit', 'override.procs' FROM (VALUES ('a'), ('b')) AS t(p)""",
)
def proc_for_op(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    calls = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    method = F.when(F.col("s_suppkey") % 3 == 0, "POST").when(F.col("s_suppkey") % 3 == 1, "get")
    named = F.when(F.col("s_nationkey") == 3, "nowhere").otherwise(F.col("n_name"))
    calls = calls.select(F.col("s_suppkey").alias("op"), method.alias("method"), F.array(F.concat(F.lit("dbo."), named)).alias("tables"))
    kinds = F.when(F.col("n_nationkey") % 3 == 1, F.array(F.lit("Select"), F.lit("Insert"))).when(F.col("n_nationkey") % 3 == 2, F.array(F.lit("Select"))).otherwise(F.array().cast("array<string>"))
    procs = nation.select(F.concat(F.lit("p_"), "n_name").alias("proc"), F.array(F.lower("n_name")).alias("tables"), kinds.alias("kinds"))
    return op.procs_for(calls, procs, spark.createDataFrame([(2, ["a", "b"]), (4, [])], "op long, procs array<string>"))


@query(
    "directive_source",
    r"""SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN CASE WHEN regexp_matches(lower(url), '\.(yaml|yml|json)$') OR contains(lower(url), 'openapi') OR contains(lower(url), 'swagger') THEN 'openapi'
    WHEN regexp_matches(lower(url), '\.(md|markdown)$') THEN 'markdown' END END AS source FROM pages""",
)
def directive_source(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", files.directive_source(F.col("url")).alias("source"))
