"""Schema, code and design operators over rows that Spark derives from the tables.

Scripts, objects, keys and routes are written from columns of ``part``, ``orders``, ``supplier`` and
``customer``, one or a few for each row.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog, graph, retrieval
from ..operators.frames import for_language
from ..sources import files as S
from .registry import query
from .retrieval_queries import hits
from .tables import table


def part(spark, sf_dir):
    return table(spark, sf_dir, "part")


def text(*parts):
    """The parts as one string; names in braces are columns."""
    return F.concat(*[F.col(p[1:-1]).cast("string") if re.fullmatch(r"\{\w+\}", p) else F.lit(p) for p in parts])


TIES_SQL = "t0 AS (SELECT doc_id // 6 AS query_id, doc_id, round(0.5::DOUBLE + (n_chars % 25) / 100.0::DOUBLE, 6) AS conf FROM documents), t1 AS (SELECT *, row_number() OVER q AS rank, max(conf) OVER (PARTITION BY query_id) AS top FROM t0 WINDOW q AS (PARTITION BY query_id ORDER BY conf DESC, doc_id)), t2 AS (SELECT *, max(conf) FILTER (WHERE rank = 2) OVER (PARTITION BY query_id) AS second FROM t1), ties AS (SELECT query_id, doc_id, conf, count(*) OVER (PARTITION BY query_id) AS n FROM t2 WHERE top < 0.95::DOUBLE AND top - second <= 0.03::DOUBLE AND conf >= top - 0.05::DOUBLE QUALIFY n >= 3)"


def _ties(spark, sf_dir):
    conf = F.round(0.5 + F.col("n_chars") % 25 / 100.0, 6)
    return retrieval.tied(table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 6).alias("query_id"), "doc_id", conf.alias("conf")))


@query("tied", "WITH " + TIES_SQL + " SELECT * FROM ties")
def tied(spark, sf_dir):
    return _ties(spark, sf_dir)


@query("tie_facets", "WITH " + TIES_SQL + """, g AS (SELECT doc_id, lang AS tag FROM documents UNION ALL SELECT doc_id, source FROM documents),
    k AS (SELECT query_id, tag, count(DISTINCT doc_id) AS k, any_value(n) AS n FROM ties JOIN g USING (doc_id) WHERE tag IS NOT NULL GROUP BY ALL)
    SELECT query_id, tag, k FROM k WHERE k < n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY k DESC, tag) <= 6""")
def tie_facets(spark, sf_dir):
    tags = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array("lang", "source")).alias("tag")).filter("tag is not null")
    return retrieval.tie_facets(_ties(spark, sf_dir), tags)


ROUTE_SQL = "SELECT conv_id * 100 + turn AS query_id, (length(text) % 12)::INTEGER AS n, (conv_id % 30) / 10.0::DOUBLE AS a, (conv_id % 50) / 10.0::DOUBLE AS m, (conv_id % 11) / 10.0::DOUBLE AS o, turn = 3 AS c FROM conversations WHERE text IS NOT NULL"


@query("query_route", f"SELECT query_id, CASE WHEN n = 0 THEN 'semantic' WHEN c THEN 'lexical' WHEN (n <= 8 AND a <= 1.2 AND m <= 2.5 AND o < 0.1) OR o >= 0.8 THEN 'semantic' ELSE 'hybrid' END AS route FROM ({ROUTE_SQL})")
def query_route(spark, sf_dir):
    c = F.col("conv_id")
    stats = table(spark, sf_dir, "conversations").filter("text is not null").select((c * 100 + F.col("turn")).alias("query_id"), (F.length("text") % 12).alias("n_words"), (c % 30 / 10.0).alias("idf_avg"), (c % 50 / 10.0).alias("idf_max"), (c % 11 / 10.0).alias("oov"), (F.col("turn") == 3).alias("code"))
    return retrieval.query_route(stats)


@query("fix_recall", """WITH f AS (SELECT doc_id // 9 AS query_id, doc_id, (n_chars % 10) / 10.0::DOUBLE * (0.3::DOUBLE + 0.4::DOUBLE * greatest(doc_id % 7, n_chars % 7) / 7.0::DOUBLE + 0.3::DOUBLE * (doc_id % 2)) AS raw FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, doc_id)::INTEGER AS rank FROM f)
    SELECT query_id, doc_id, rank, round(CASE WHEN rank = 1 THEN raw ELSE 0.05 END, 6) AS score FROM r""")
def fix_recall(spark, sf_dir):
    n, d = F.col("n_chars"), F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(F.floor(d / 9).alias("query_id"), "doc_id", (n % 10 / 10.0).alias("rel"), (d % 7 / 7.0).alias("cos"), (n % 7 / 7.0).alias("fp"), (d % 2 * 1.0).alias("intent"))
    return retrieval.fix_score(rows).withColumn("score", F.round("score", 6))


@query("fk_toposort", """SELECT 'r' || r_regionkey AS node, 0 AS level, TRUE AS placed FROM region UNION ALL SELECT 'n' || n_nationkey, 1, TRUE FROM nation UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey % 50 = 7 THEN 4 ELSE 2 END, c_custkey % 50 <> 7 FROM customer
    UNION ALL SELECT 'o' || o_orderkey, CASE WHEN o_custkey % 50 = 7 THEN 4 ELSE 3 END, o_custkey % 50 <> 7 FROM orders""")
def fk_toposort(spark, sf_dir):
    """Rows that refer to rows; some customers refer to each other, so they and their orders hang
    on cycles."""
    t = lambda name: table(spark, sf_dir, name)
    refs = [
        t("region").select(text("r", "{r_regionkey}"), F.lit(None).cast("string")),
        t("nation").select(text("n", "{n_nationkey}"), text("r", "{n_regionkey}")),
        t("customer").select(text("c", "{c_custkey}"), text("n", "{c_nationkey}")),
        t("customer").filter("c_custkey % 50 = 7").select(text("c", "{c_custkey}"), text("d", "{c_custkey}")),
        t("customer").filter("c_custkey % 50 = 7").select(text("d", "{c_custkey}"), text("c", "{c_custkey}")),
        t("orders").select(text("o", "{o_orderkey}"), text("c", "{o_custkey}")),
    ]
    edges = refs[0].toDF("node", "target")
    for more in refs[1:]:
        edges = edges.union(more.toDF("node", "target"))
    return graph.layers(edges.select("node"), edges.filter("target is not null")).filter("node not like 'd%'")


def _views(spark, sf_dir):
    """A view for each part that reads the view after it and a table; comments and strings name
    others."""
    numbered = part(spark, sf_dir).withColumn("b", F.col("p_partkey") + 1)
    return numbered.select(text("v", "{p_partkey}").alias("name"), text("SELECT 'v0' FROM dbo.V", "{b}", " o JOIN [t", "{p_size}", "] c ON 1=1 /* v1 */ WHERE dbo.fn_", "{p_type}", "(1) > 0 -- v2").alias("body"))


@query("dep_edges", "SELECT 'v' || p_partkey AS name, 'v' || (p_partkey + 1) AS target FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part)")
def dep_edges(spark, sf_dir):
    return graph.dependency_edges(_views(spark, sf_dir))


@query("missing_refs", "WITH r AS (SELECT 'v' || p_partkey AS name, unnest(['v' || (p_partkey + 1), 't' || p_size, 'fn_' || lower(p_type)]) AS missing FROM part) SELECT missing, string_agg(name, ',' ORDER BY name) AS callers FROM r WHERE missing NOT IN (SELECT 'v' || p_partkey FROM part) GROUP BY missing")
def missing_refs(spark, sf_dir):
    return graph.missing_references(_views(spark, sf_dir))


@query("positional_diff", "SELECT p_partkey AS pos, CASE WHEN p_partkey % 13 <> 5 THEN p_name END AS old, CASE WHEN p_size > 45 THEN p_type ELSE p_name END AS new FROM part WHERE p_partkey % 13 = 5 OR p_size > 45 ORDER BY 1 LIMIT 5")
def positional_diff(spark, sf_dir):
    old = part(spark, sf_dir).filter("p_partkey % 13 <> 5").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("content"))
    new = part(spark, sf_dir).select(F.col("p_partkey").alias("pos"), F.when(F.col("p_size") > 45, F.col("p_type")).otherwise(F.col("p_name")).alias("content"))
    return catalog.positional_diff(old, new)


@query("array_diff", "WITH g AS (SELECT p_brand, list(lower(p_name)) FILTER (WHERE p_size < 30) AS want, list(lower(p_name)) FILTER (WHERE p_size > 20) AS have FROM part GROUP BY 1) SELECT p_brand, array_to_string(list_sort(list_distinct(list_filter(want, lambda x: NOT list_contains(have, x)))), ',') AS missing, array_to_string(list_sort(list_distinct(list_filter(have, lambda x: NOT list_contains(want, x)))), ',') AS extra FROM g WHERE want IS NOT NULL AND have IS NOT NULL")
def array_diff(spark, sf_dir):
    named = lambda which, c: F.collect_set(F.when(which, F.upper(c)))
    rows = part(spark, sf_dir).groupBy("p_brand").agg(named(F.col("p_size") < 30, "p_name").alias("want"), named(F.col("p_size") > 20, "p_name").alias("have"))
    found = catalog.array_diff(rows.filter("size(want) > 0 and size(have) > 0"), "want", "have")
    return found.select("p_brand", F.concat_ws(",", "missing").alias("missing"), F.concat_ws(",", "extra").alias("extra"))


@query("schema_drift", """SELECT 'dbo' AS schema, 't' || p_size AS "table", 'c' || p_partkey AS "column", CASE WHEN p_partkey % 7 = 0 THEN 'missing' WHEN p_partkey % 5 = 0 THEN 'extra' ELSE 'type' END AS state FROM part WHERE (p_partkey % 7 = 0) <> (p_partkey % 5 = 0) OR (p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 11 = 0)""")
def schema_drift(spark, sf_dir):
    row = lambda dbo, c, kind: [F.lit(dbo).alias("schema"), text("T", "{p_size}").alias("table"), text(c, "{p_partkey}").alias("column"), kind.alias("type")]
    want = part(spark, sf_dir).filter("p_partkey % 5 <> 0").select(*row("dbo", "C", F.lower("p_type")))
    live = part(spark, sf_dir).filter("p_partkey % 7 <> 0").select(*row("DBO", "c", F.when(F.col("p_partkey") % 11 == 0, "other").otherwise(F.col("p_type"))))
    return catalog.drift(want, live)


@query("fk_one_hop", """SELECT 'c' || c_custkey AS "table" FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT 'n' || c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING'""")
def fk_one_hop(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    fks = customers.select(text("c", "{c_custkey}").alias("table"), text("n", "{c_nationkey}").alias("target"))
    orders = table(spark, sf_dir, "orders").select(text("o", "{o_orderkey}").alias("table"), text("c", "{o_custkey}").alias("target"))
    return catalog.fk_one_hop(customers.filter("c_mktsegment = 'BUILDING'").select(text("c", "{c_custkey}").alias("table")), fks.union(orders))


@query("suffix_join", """SELECT 'dbo.' || upper(replace(p_name, ' ', '_')) || '.P' || p_partkey AS name, 'p' || s_suppkey AS "table" FROM part JOIN supplier ON p_partkey = s_suppkey""")
def suffix_join(spark, sf_dir):
    names = part(spark, sf_dir).select(F.concat(F.lit("dbo."), F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))), text(".P", "{p_partkey}")).alias("name"))
    return catalog.suffix_join(names, table(spark, sf_dir, "supplier").select(text("p", "{s_suppkey}").alias("table")))


@query("column_match", """SELECT 'orderKey' || p_partkey AS field, CASE p_partkey % 7 WHEN 0 THEN 'orderKey' WHEN 1 THEN 'ORDERKEY' WHEN 2 THEN 'strOrderKey' WHEN 3 THEN 'order_key' WHEN 4 THEN 'own' WHEN 5 THEN NULL ELSE 'orderKey' END || p_partkey AS "column",
    CASE p_partkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 0 WHEN 6 THEN 1 END AS rule FROM part""")
def column_match(spark, sf_dir):
    rows, kind = part(spark, sf_dir), F.col("p_partkey") % 7
    own = F.when(kind == 0, "orderKey").when(kind == 1, "ORDERKEY").when(kind == 2, "strOrderKey").when(kind == 3, "order_key").when(kind == 4, "orderKey").when(kind == 5, "other").otherwise("orderKey")
    key = F.col("p_partkey").cast("string")
    columns = rows.select(F.concat(own, key).alias("column")).union(rows.filter(kind == 6).select(F.concat(F.lit("OrderKey"), key)))
    return catalog.column_match(rows.select(text("orderKey", "{p_partkey}").alias("field")), columns, rows.filter(kind == 4).select(text("orderKey", "{p_partkey}").alias("field"), text("own", "{p_partkey}").alias("column")))


@query("coverage_status", """WITH k AS (SELECT o_orderkey AS key, o_orderkey % 2 = 0 AS s, o_orderkey % 3 = 0 AS r, o_orderkey % 5 < 3 AS c, o_orderkey % 7 = 0 AS t FROM orders)
    SELECT key, CASE WHEN s AND r AND c AND t THEN 'complete' WHEN s AND r AND c THEN 'untested' WHEN s AND r THEN 'not built' WHEN s AND c THEN 'unregistered' WHEN s THEN 'specified' WHEN c THEN 'undocumented' ELSE 'stale' END AS status FROM k WHERE s OR r OR c OR t""")
def coverage_status(spark, sf_dir):
    of = lambda which: table(spark, sf_dir, "orders").filter(which).select(F.col("o_orderkey").alias("key"))
    return catalog.coverage(of("o_orderkey % 2 = 0"), of("o_orderkey % 3 = 0"), of("o_orderkey % 5 < 3"), of("o_orderkey % 7 = 0"))


@query("glob_filter", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 1 AND o_custkey < 10 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey % 2 = 0")
def glob_filter(spark, sf_dir):
    method = F.when(F.col("o_orderstatus") == "F", "get").otherwise("post")
    path = F.concat(F.lit("/v"), (F.col("o_orderkey") % 3).cast("string"), F.lit("/users/"), F.col("o_custkey").cast("string"))
    kind = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "story").otherwise("task")
    tags = F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("b")))
    stories = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), method.alias("method"), path.alias("path"), kind.alias("kind"), tags.alias("tags"), text("Read User ", "{o_custkey}").alias("text"))
    return catalog.story_filter(stories, "GET", "/v1/*/?", "story", "a", "USER").select("id")


@query("glossary_lookup", "SELECT n_name AS lookup, (SELECT string_agg(DISTINCT 'type' || (s_suppkey % 3), ',' ORDER BY 'type' || (s_suppkey % 3)) FROM supplier WHERE s_nationkey = n_nationkey) AS types FROM nation")
def glossary_lookup(spark, sf_dir):
    suppliers, nations = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    columns = suppliers.select(F.col("s_name").alias("table"), F.lit("nation").alias("column"), F.concat(F.lit("type"), (F.col("s_suppkey") % 3).cast("string")).alias("type"))
    fks = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("table"), F.lit("nation").alias("column"), F.col("n_name").alias("target"))
    return catalog.glossary(nations.select(F.col("n_name").alias("lookup")), columns, fks)


@query("type_fits", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size % 2 = 0 WHEN 1 THEN p_size % 2 = 1 WHEN 2 THEN p_size % 2 = 1 ELSE FALSE END AS fits FROM part")
def type_fits(spark, sf_dir):
    kind = F.col("p_partkey") % 4
    logical = F.when(kind == 0, "String").when(kind == 1, "integer").when(kind == 2, "number").otherwise("blob")
    sql = F.when(F.col("p_size") % 2 == 0, text("NVARCHAR(", "{p_size}", ")")).otherwise("BigInt")
    return part(spark, sf_dir).select("p_partkey", catalog.type_fits(logical, sql).alias("fits"))


def _scripts(spark, sf_dir):
    script = text("CREATE TABLE dbo.T", "{p_partkey}", " (id int NOT NULL, c", "{p_size}", " decimal(9,2), cust int REFERENCES dbo.T", "{p_size}", ", CONSTRAINT c CHECK (c > 0))\nGO\nCREATE PROCEDURE [dbo].[p", "{p_partkey}", "] AS EXEC sp_executesql N'x'\n go \nSELECT 1")
    return S.sql_batches(part(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("file"), script.alias("text")))


@query("sql_batches", "SELECT p_partkey::VARCHAR AS file, unnest([0, 1, 2]) AS pos, unnest(['table', 'procedure', 'statement']) AS kind, unnest(['dbo.T' || p_partkey, 'dbo.p' || p_partkey, '']) AS name, unnest(['fk:dbo.t' || p_size || ',check', 'dynamic_sql', '']) AS tags FROM part")
def sql_batches(spark, sf_dir):
    return _scripts(spark, sf_dir).select("file", "pos", "kind", "name", F.concat_ws(",", "tags").alias("tags"))


@query("ddl_columns", """SELECT 'dbo.T' || p_partkey AS "table", unnest(['id', 'c' || p_size, 'cust']) AS "column", unnest(['int', 'decimal', 'int']) AS type, unnest([FALSE, TRUE, TRUE]) AS nullable FROM part""")
def ddl_columns(spark, sf_dir):
    return S.create_table_columns(_scripts(spark, sf_dir))


@query("code_chunks", "SELECT p_partkey::VARCHAR AS file, unnest(['load' || p_partkey, 'Store', 'open']) AS name, unnest(['def', 'class', 'def']) AS kind, unnest([2, 4, 5]) AS line, unnest(['read' || p_size, '', 'load' || p_partkey]) AS calls FROM part")
def code_chunks(spark, sf_dir):
    code = text("import os\ndef load", "{p_partkey}", "(x):\n    return read", "{p_size}", "(x)\nclass Store:\n    def open(self):\n        return load", "{p_partkey}", "(1)\n")
    found = S.code_chunks(part(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("file"), code.alias("text")))
    return found.select("file", "name", "kind", "line", F.concat_ws(",", "calls").alias("calls"))


@query("openapi_operations", "SELECT p_partkey::VARCHAR AS file, '/parts/' || p_partkey AS path, unnest(['get', 'post']) AS method, unnest(['list' || p_size, 'add' || p_partkey]) AS operation_id FROM part")
def openapi_operations(spark, sf_dir):
    spec = text('{"paths": {"/parts/', "{p_partkey}", '": {"get": {"operationId": "list', "{p_size}", '"}, "post": {"operationId": "add', "{p_partkey}", '"}}}}')
    return S.openapi_operations(part(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("file"), spec.alias("text")))


@query("markdown_sections", "SELECT doc_id::VARCHAR AS file, unnest([1, 2]) AS level, unnest(['Goals of ' || source, 'Scope']) AS heading, unnest([md5(regexp_replace(regexp_replace(text, '^\\s*', ''), '\\s+$', '')), md5('')]) AS body FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '(^|\\n)#{1,6} ')".replace("\\\\", "\\"))
def markdown_sections(spark, sf_dir):
    page = text("intro\n# Goals of ", "{source}", "\n", "{text}", "\n## Scope\n")
    rows = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull() & ~F.col("text").rlike("(^|\n)#{1,6} "))
    found = S.markdown_requirements(rows.select(F.col("doc_id").cast("string").alias("file"), page.alias("text")))
    return found.select("file", "level", "heading", F.md5("body").alias("body"))


@query("transcript_frames", "SELECT 'm' || user_id || '.mp3::seg_' || lpad((event_id * 250)::VARCHAR, 10, '0') AS doc_id, printf('start:%.2f', event_id / 4.0) AS tag FROM events WHERE event_type <> 'view'")
def transcript_frames(spark, sf_dir):
    at = F.col("event_id") / 4.0
    rows = table(spark, sf_dir, "events").select(text("/in/m", "{user_id}", ".mp3").alias("file"), at.alias("start"), (at + 0.2).alias("end"), F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type")).alias("text"))
    return S.transcript_frames(rows).select("doc_id", F.element_at("tags", 1).alias("tag"))


@query("procedure_facts", "SELECT 'p' || p_partkey AS name, unnest(['parameter', 'json', 'changes', 'literal', 'error']) AS kind, unnest(['@id' || p_size, 'order.k' || p_size, 'T' || p_partkey, p_brand, (50000 + p_partkey)::VARCHAR]) AS value FROM part")
def procedure_facts(spark, sf_dir):
    rows = part(spark, sf_dir).withColumn("code", 50000 + F.col("p_partkey"))
    body = text("CREATE PROC p @id", "{p_size}", " int AS UPDATE dbo.T", "{p_partkey}", " SET s = JSON_VALUE(@j, '$.order.k", "{p_size}", "') WHERE state = '", "{p_brand}", "'; THROW ", "{code}", ", 'x', 1")
    return S.procedure_facts(rows.select(text("p", "{p_partkey}").alias("name"), body.alias("body")))


@query("name_forms", r"""WITH w AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_name, p_size FROM part)
    SELECT p_partkey, a || '_' || b || ' ' || a || upper(left(b, 1)) || substr(b, 2) || ' ' || upper(left(a, 1)) || substr(a, 2) || upper(left(b, 1)) || substr(b, 2) AS spellings, b || '_category' AS singular, '/v' || p_size || '/' || a || '/{}' AS path FROM w""")
def name_forms(spark, sf_dir):
    words = F.split("p_name", " ")
    return part(spark, sf_dir).select(
        "p_partkey",
        F.concat_ws(" ", T.spellings(words)).alias("spellings"),
        T.singular(F.concat(words[1], F.lit("_categories"))).alias("singular"),
        T.normal_path(F.concat(F.lit("V"), F.col("p_size").cast("string"), F.lit("//"), words[0], F.lit("/:id/"))).alias("path"),
    )


@query("language_filter", "SELECT doc_id AS id FROM documents WHERE CASE doc_id % 3 WHEN 0 THEN upper(lang) WHEN 1 THEN CASE WHEN n_chars % 2 = 0 THEN lang END ELSE 'go' END IS NULL OR lower(CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN CASE WHEN n_chars % 2 = 0 THEN lang END ELSE 'go' END) = 'en'")
def language_filter(spark, sf_dir):
    d = F.col("doc_id") % 3
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(d == 0, F.upper("lang")).alias("tag_lang"), F.when((d == 1) & (F.col("n_chars") % 2 == 0), F.col("lang")).alias("body_lang"), F.when(d != 1, "go").alias("edits_lang"))
    return for_language(rows, "en").select("id")
