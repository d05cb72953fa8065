"""Operators on a few typed rows whose answers are known by hand."""

import duckdb
import pytest
from oracle import expected, rows_of
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators import catalog, graph, retrieval, state
from mnemospark.operators import text as text_ops
from mnemospark.sources import files as S

CASES = {}


def case(name, answer):
    def add(function):
        CASES[name] = (function, answer)
        return function

    return add


QUESTIONS = [(1, "What is the passkey for version 4 of the Client report?"), (2, "show draft v12 from dept 7"), (3, "rev 3, final numbers"), (4, "who wrote this confidential memo"), (5, "thanks")]


def questions(spark):
    return spark.createDataFrame(QUESTIONS, "query_id long, text string")


@case("split_identifier", "SELECT * FROM (VALUES ('getUserName', 'get user name'), ('HTTPServer_v2', 'http server v2'), ('snake_case_id', 'snake case id'), ('x', 'x')) AS t(name, parts)")
def split_identifier(spark, sf_dir):
    names = spark.createDataFrame([("getUserName",), ("HTTPServer_v2",), ("snake_case_id",), ("x",)], "name string")
    return names.select("name", F.concat_ws(" ", T.split_identifier(F.col("name"))).alias("parts"))


@case("soundex_ref", "SELECT * FROM (VALUES ('ashcraft', 'A226'), ('Robert', 'R163'), ('Rupert', 'R163'), ('Tymczak', 'T522'), ('', '0000'), ('12', '0000')) AS t(word, code)")
def soundex_ref(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w in ("ashcraft", "Robert", "Rupert", "Tymczak", "", "12")], "word string")
    return words.select("word", T.sounds(F.col("word")).alias("code"))


@case("fuzzy_expand", "SELECT * FROM (VALUES ('pasword', 'password', 1, 1), ('licence', 'license', 1, 1), ('version', 'version', 0, 1)) AS t(word, match, distance, rank)")
def fuzzy_expand(spark, sf_dir):
    vocabulary = spark.createDataFrame([(w,) for w in ("password", "license", "version", "verses", "report")], "word string")
    return text_ops.fuzzy(spark.createDataFrame([("pasword",), ("licence",), ("version",)], "word string"), vocabulary)


@case("morph_variants", "SELECT * FROM (VALUES ('workers', 'workers work worker'), ('testing', 'testing test'), ('well-known', 'well-known well known'), ('boxes', 'boxes box boxe'), ('is', 'is')) AS t(word, forms)")
def morph_variants(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w in ("workers", "testing", "well-known", "boxes", "is")], "word string")
    return words.select("word", F.concat_ws(" ", T.variants(F.col("word"))).alias("forms"))


@case("compound_split", "SELECT * FROM (VALUES ('passkey', 'pass key'), ('password', 'pass word'), ('other', 'other')) AS t(word, parts)")
def compound_split(spark, sf_dir):
    words = spark.createDataFrame([("passkey",), ("password",), ("other",)], "word string")
    return words.select("word", F.concat_ws(" ", T.compounds(F.col("word"))).alias("parts"))


@case("keywords", "SELECT * FROM (VALUES (1::BIGINT, 'passkey version 4 client report'), (2, 'show draft v12 dept 7'), (3, 'rev 3 final numbers'), (4, 'wrote confidential memo'), (5, 'thanks')) AS t(query_id, words)")
def keywords(spark, sf_dir):
    return questions(spark).select("query_id", F.concat_ws(" ", T.keywords(F.col("text"))).alias("words"))


@case("detect_scope_tag", "SELECT * FROM (VALUES (1::BIGINT, 'version:4'), (2, 'dept:7'), (3, 'version:3'), (4, 'status:confidential'), (5, NULL)) AS t(query_id, tag)")
def detect_scope_tag(spark, sf_dir):
    return questions(spark).select("query_id", T.scope_tag(F.col("text")).alias("tag"))


@case("wikilinks", "SELECT * FROM (VALUES (1::BIGINT, 'alpha'), (1, 'beta gamma'), (3, 'delta')) AS t(id, concept)")
def wikilinks(spark, sf_dir):
    rows = [(1, "see [[Alpha]] and [[Beta Gamma|x]] and [[alpha#y]]"), (2, "m[[i]] [[12]] [[a]]"), (3, "([[delta]])")]
    return spark.createDataFrame(rows, "id long, text string").select("id", F.explode(T.wikilinks(F.col("text"))).alias("concept"))


@case("action_residue", "SELECT * FROM (VALUES (1::BIGINT, 'fix the race in'), (2, 'rename to')) AS t(id, residue)")
def action_residue(spark, sf_dir):
    rows = spark.createDataFrame([(1, "Fix the race in src/main.rs"), (2, "rename foo_bar to v2")], "id long, text string")
    return rows.select("id", T.action_residue(F.col("text")).alias("residue"))


@case("search_kv", "SELECT * FROM (VALUES (1::BIGINT, '8412'), (2, 'blue'), (3, '')) AS t(id, value)")
def search_kv(spark, sf_dir):
    rows = spark.createDataFrame([(1, "The passkey is 8412; keep it"), (2, "color: blue, size 4"), (3, "none")], "id long, text string")
    return rows.select("id", F.coalesce(F.nullif(F.trim(T.value_of_key(F.col("text"), "passkey")), F.lit("")), F.trim(T.value_of_key(F.col("text"), "color"))).alias("value"))


@case("auto_tags", "SELECT * FROM (VALUES (1::BIGINT, 'version:3'), (1, 'status:draft'), (2, 'version:7'), (2, 'status:confidential'), (3, 'status:final')) AS t(id, tag)")
def auto_tags(spark, sf_dir):
    rows = spark.createDataFrame([(1, "plan_v3_draft.docx", "text"), (2, "notes.md", "Revision 7 CONFIDENTIAL"), (3, "final.pdf", "x")], "id long, name string, text string")
    return rows.select("id", F.explode(T.auto_tags(F.col("name"), F.col("text"))).alias("tag"))


@case("ground_dates", "SELECT * FROM (VALUES (1::BIGINT, 'sales last year [last year = 2023]'), (2, 'since last quarter and last month [last quarter = Q4 2023] [last month = 2024-01]'), (3, 'now')) AS t(id, text)")
def ground_dates(spark, sf_dir):
    rows = spark.createDataFrame([(1, "sales last year"), (2, "since last quarter and last month"), (3, "now")], "id long, text string")
    return rows.select("id", T.ground_dates(F.col("text"), F.lit("2024-02-10").cast("date")).alias("text"))


@case("clean_text", "SELECT * FROM (VALUES (1::BIGINT, 'hello woorld'), (2, ''), (3, 'a b')) AS t(id, text)")
def clean_text(spark, sf_dir):
    rows = spark.createDataFrame([(1, "hello   woooorld"), (2, "-- ** !!"), (3, "a\n b")], "id long, text string")
    return rows.select("id", T.clean_ocr(F.col("text")).alias("text"))


@case("extract_calls", "SELECT * FROM (VALUES (1::BIGINT, 'foo'), (1, 'bar'), (2, 'usp_Load')) AS t(id, call)")
def extract_calls(spark, sf_dir):
    rows = spark.createDataFrame([(1, "if (foo(bar (1))) return"), (2, "EXEC dbo.usp_Load @x=1")], "id long, text string")
    return rows.select("id", F.explode(T.calls(F.col("text"))).alias("call"))


@case("cjk_bigrams", "SELECT * FROM (VALUES (1::BIGINT, '日本'), (1, '本語'), (2, '中文')) AS t(id, gram)")
def cjk_bigrams(spark, sf_dir):
    rows = spark.createDataFrame([(1, "abc 日本語 x"), (2, "中文"), (3, "one 語 two")], "id long, text string")
    return rows.select("id", F.explode(T.cjk_bigrams(F.col("text"))).alias("gram"))


@case("stitch_pages", "SELECT * FROM (VALUES (1::BIGINT, 'It began. The end'), (2, 'The end of the story.'), (3, 'New page')) AS t(page, text)")
def stitch_pages(spark, sf_dir):
    rows = [("s", 1, "It began. The end"), ("s", 2, "of the story."), ("s", 3, "New page")]
    return text_ops.stitch_pages(spark.createDataFrame(rows, "source string, page long, text string")).select("page", "text")


@case("ngram_tiebreak", "SELECT * FROM (VALUES (1::BIGINT, 1.2), (2, 1.0), (3, 1.85)) AS t(doc_id, score0)".replace("score0", "score").replace("1.2)", "1.2::DOUBLE)"))
def ngram_tiebreak(spark, sf_dir):
    hits = spark.createDataFrame([(1, 1.0, "red fox ran"), (2, 1.0, "a lazy day"), (3, 1.0, "quick brown dog")], "doc_id long, score double, text string")
    return text_ops.ngram_tiebreak(hits, "red fox quick brown dog").withColumn("score", F.round("score", 6))


@case("stem_tokens", "SELECT * FROM (VALUES (1::BIGINT, 'consist'), (2, 'knight'), (3, 'generous'), (4, 'sky'), (5, 'run'), (6, 'happili'), (7, 'relat'), (8, 'hope'), (9, 'hop'), (10, 'communic'), (11, 'die'), (12, 'national'), (13, 'cafés')) AS t(id, stem)".replace("'national'", "'nation'"))
def stem_tokens(spark, sf_dir):
    from mnemospark.functions.stem import stems

    words = "consistency knightly generously skies running happily relational hoping hopping communication dying national cafés".split()
    rows = spark.createDataFrame(list(enumerate(words, 1)), "id long, word string")
    return rows.select("id", F.element_at(stems(F.array("word")), 1).alias("stem"))


@case("word_pieces", "SELECT * FROM (VALUES (1::BIGINT, 'play ##ing the [UNK] .')) AS t(id, pieces)")
def word_pieces(spark, sf_dir):
    from mnemospark.functions.stem import word_pieces

    tokenize = word_pieces({"play", "##ing", "the", "."})
    return spark.createDataFrame([(1, "Playing the xylophone.")], "id long, text string").select("id", F.concat_ws(" ", tokenize(F.col("text"))).alias("pieces"))


@case("tied", "SELECT * FROM (VALUES (1::BIGINT, 1::BIGINT, 0.8::DOUBLE, 3::BIGINT), (1, 2, 0.79, 3), (1, 3, 0.76, 3)) AS t(query_id, doc_id, conf, n)")
def tied(spark, sf_dir):
    rows = [(1, 1, 0.8), (1, 2, 0.79), (1, 3, 0.76), (1, 4, 0.2), (2, 1, 0.99), (2, 2, 0.98), (2, 3, 0.97), (3, 1, 0.5)]
    return retrieval.tied(spark.createDataFrame(rows, "query_id long, doc_id long, conf double"))


@case("tie_facets", "SELECT * FROM (VALUES (1::BIGINT, 'a', 2::BIGINT), (1, 'c', 1)) AS t(query_id, tag, k)")
def tie_facets(spark, sf_dir):
    ties = spark.createDataFrame([(1, 1, 0.8, 3), (1, 2, 0.79, 3), (1, 3, 0.76, 3)], "query_id long, doc_id long, conf double, n long")
    tags = spark.createDataFrame([(1, "a"), (2, "a"), (1, "b"), (2, "b"), (3, "b"), (3, "c")], "doc_id long, tag string")
    return retrieval.tie_facets(ties, tags)


@case("query_route", "SELECT * FROM (VALUES (1::BIGINT, 'lexical'), (2, 'semantic'), (3, 'hybrid'), (4, 'semantic'), (5, 'semantic')) AS t(query_id, route)")
def query_route(spark, sf_dir):
    rows = [(1, 3, 2.0, 3.0, 0.0, True), (2, 5, 1.1, 2.0, 0.0, False), (3, 5, 2.0, 4.0, 0.2, False), (4, 5, 2.0, 4.0, 0.9, False), (5, 0, 0.0, 0.0, 0.0, False)]
    return retrieval.query_route(spark.createDataFrame(rows, "query_id long, n_words int, idf_avg double, idf_max double, oov double, code boolean"))


@case("fix_recall", "SELECT * FROM (VALUES (1::BIGINT, 10::BIGINT, 1, 0.612::DOUBLE), (1, 11, 2, 0.05), (2, 12, 1, 0.15)) AS t(query_id, doc_id, rank, score)")
def fix_recall(spark, sf_dir):
    rows = [(1, 10, 0.9, 0.5, 0.2, 0.6), (1, 11, 0.5, 0.1, 0.4, 0.0), (2, 12, 0.5, 0.0, 0.0, 0.0)]
    found = retrieval.fix_score(spark.createDataFrame(rows, "query_id long, doc_id long, rel double, cos double, fp double, intent double"))
    return found.withColumn("score", F.round("score", 6))


@case("fk_toposort", "SELECT * FROM (VALUES ('region', 0), ('nation', 1), ('customer', 2), ('supplier', 2), ('orders', 3), ('lineitem', 4), ('x', 5), ('y', 5)) AS t(node, level)")
def fk_toposort(spark, sf_dir):
    nodes = spark.createDataFrame([(x,) for x in ("region", "nation", "customer", "supplier", "orders", "lineitem", "x", "y")], "node string")
    fks = [("nation", "region"), ("customer", "nation"), ("supplier", "nation"), ("orders", "customer"), ("lineitem", "orders"), ("lineitem", "supplier"), ("lineitem", "unknown"), ("region", "region"), ("x", "y"), ("y", "x")]
    return graph.layers(nodes, spark.createDataFrame(fks, "node string, target string")).drop("placed")


OBJECTS = [("vOrders", "SELECT * FROM dbo.Orders o JOIN Customers c ON 1=1 -- Items"), ("Orders", "CREATE TABLE Orders (id int)"), ("Customers", "CREATE TABLE Customers (id int)"), ("Items", "x"), ("pLoad", "EXEC dbo.usp_Gone 'Orders'; /* vOrders */ SELECT dbo.fn_None(1) FROM vOrders")]


@case("dep_edges", "SELECT * FROM (VALUES ('vOrders', 'orders'), ('vOrders', 'customers'), ('pLoad', 'vorders')) AS t(name, target)")
def dep_edges(spark, sf_dir):
    return graph.dependency_edges(spark.createDataFrame(OBJECTS, "name string, body string"))


@case("missing_refs", "SELECT * FROM (VALUES ('usp_gone', 'pLoad'), ('fn_none', 'pLoad')) AS t(missing, callers)")
def missing_refs(spark, sf_dir):
    return graph.missing_references(spark.createDataFrame(OBJECTS, "name string, body string"))


@case("salience_golden", "SELECT * FROM (VALUES (1::BIGINT, 73, 'high', 'salience:high,explicit'), (2, 0, 'low', 'salience:low'), (3, 40, 'medium', 'salience:medium,decision')) AS t(id, score, band, tags)")
def salience_golden(spark, sf_dir):
    rows = [(1, "Important: the API key is key_abc123, never share it", "semantic"), (2, "ok thanks", "episodic"), (3, "We decided: the store is Parquet and the decision: is final", "episodic")]
    found = state.salience_tags(spark.createDataFrame(rows, "id long, text string, pillar string"))
    return found.select("id", "score", "band", F.concat_ws(",", "salience_tags").alias("tags"))


@case("surprise", "SELECT * FROM (VALUES (1::BIGINT, 'benign'), (2, 'update'), (3, 'contradiction'), (4, 'benign')) AS t(id, surprise)")
def surprise(spark, sf_dir):
    rows = spark.createDataFrame([(1, 0.1, 0.99), (2, 0.8, 0.95), (3, 0.8, 0.5), (4, 0.8, 0.1)], "id long, similarity double, overlap double")
    return state.surprise(rows).select("id", "surprise")


@case("dream_clusters", "SELECT * FROM (VALUES (1::BIGINT, 1::BIGINT), (1, 2), (1, 3), (4, 4), (4, 5)) AS t(leader, member)")
def dream_clusters(spark, sf_dir):
    rows = [(1, 1, 2), (1, 1, 3), (1, 3, 4), (1, 4, 5)]
    return state.greedy_groups(spark.createDataFrame(rows, "root long, a long, b long"), "a", "b")


@case("positional_diff", "SELECT * FROM (VALUES (2::BIGINT, 'b', 'x'), (4, NULL, 'd')) AS t(pos, old, new)")
def positional_diff(spark, sf_dir):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "pos long, content string")
    return catalog.positional_diff(old, spark.createDataFrame([(1, "a"), (2, "x"), (3, "c"), (4, "d")], "pos long, content string"))


@case("array_diff", "SELECT * FROM (VALUES (1::BIGINT, 'name', 'total'), (2, '', '')) AS t(id, missing, extra)")
def array_diff(spark, sf_dir):
    rows = spark.createDataFrame([(1, ["Id", "Name"], ["id", "Total"]), (2, ["A"], ["a"])], "id long, want array<string>, have array<string>")
    found = catalog.array_diff(rows, "want", "have")
    return found.select("id", F.concat_ws(",", "missing").alias("missing"), F.concat_ws(",", "extra").alias("extra"))


@case("schema_drift", "SELECT * FROM (VALUES ('dbo', 'orders', 'total', 'missing'), ('dbo', 'orders', 'note', 'extra'), ('dbo', 'orders', 'id', 'type')) AS t(\"schema\", \"table\", \"column\", state)")
def schema_drift(spark, sf_dir):
    s = "schema string, table string, column string, type string"
    want = spark.createDataFrame([("dbo", "Orders", "Id", "int"), ("dbo", "Orders", "Total", "decimal"), ("dbo", "Orders", "At", "date")], s)
    return catalog.drift(want, spark.createDataFrame([("DBO", "orders", "id", "bigint"), ("dbo", "orders", "note", "text"), ("dbo", "orders", "at", "DATE")], s))


@case("fk_one_hop", "SELECT * FROM (VALUES ('orders'), ('customers')) AS t(\"table\")")
def fk_one_hop(spark, sf_dir):
    fks = spark.createDataFrame([("orders", "customers"), ("customers", "nations")], "table string, target string")
    return catalog.fk_one_hop(spark.createDataFrame([("orders",)], "table string"), fks)


@case("suffix_join", "SELECT * FROM (VALUES ('dbo.Orders', 'orders'), ('orders', 'orders')) AS t(name, \"table\")")
def suffix_join(spark, sf_dir):
    return catalog.suffix_join(spark.createDataFrame([("dbo.Orders",), ("orders",), ("x.y",)], "name string"), spark.createDataFrame([("orders",), ("items",)], "table string"))


@case("column_match", "SELECT * FROM (VALUES ('Id', 'id', 2), ('total', 'total', 1), ('Name', 'strName', 3), ('orderId', 'order_id', 4), ('x', 'y', 0), ('none', NULL, NULL)) AS t(field, \"column\", rule)")
def column_match(spark, sf_dir):
    fields = spark.createDataFrame([(x,) for x in ("Id", "total", "Name", "orderId", "x", "none")], "field string")
    columns = spark.createDataFrame([(x,) for x in ("id", "total", "strName", "order_id", "y")], "column string")
    return catalog.column_match(fields, columns, spark.createDataFrame([("x", "y")], "field string, column string"))


@case("coverage_status", "SELECT * FROM (VALUES ('a', 'complete'), ('b', 'untested'), ('c', 'not built'), ('d', 'unregistered'), ('e', 'specified'), ('f', 'undocumented'), ('g', 'stale')) AS t(key, status)")
def coverage_status(spark, sf_dir):
    keys = lambda x: spark.createDataFrame([(k,) for k in x], "key string")
    return catalog.coverage(keys("abcde"), keys("abcg"), keys("abdf"), keys("a"))


@case("glob_filter", "SELECT * FROM (VALUES (1::BIGINT)) AS t(id)")
def glob_filter(spark, sf_dir):
    rows = [(1, "get", "/v1/users/7", "story", ["a"], "Read a user"), (2, "get", "/v2/users/7", "story", ["a"], "Read a user"), (3, "post", "/v1/users/7", "story", ["a"], "x"), (4, "get", "/v1/users/7", "story", ["b"], "Read a user")]
    stories = spark.createDataFrame(rows, "id long, method string, path string, kind string, tags array<string>, text string")
    return catalog.story_filter(stories, "GET", "/v1/*/?", "story", "a", "USER").select("id")


@case("glossary_lookup", "SELECT * FROM (VALUES ('status', 'int,tinyint'), ('kind', NULL)) AS t(lookup, types)")
def glossary_lookup(spark, sf_dir):
    columns = spark.createDataFrame([("orders", "status_id", "int"), ("items", "status", "tinyint")], "table string, column string, type string")
    fks = spark.createDataFrame([("orders", "status_id", "status"), ("items", "status", "status")], "table string, column string, target string")
    return catalog.glossary(spark.createDataFrame([("status",), ("kind",)], "lookup string"), columns, fks)


@case("type_fits", "SELECT * FROM (VALUES ('string', 'NVARCHAR(50)', TRUE), ('integer', 'decimal(9,2)', FALSE), ('number', 'decimal(9,2)', TRUE), ('blob', 'int', FALSE)) AS t(logical, sql, fits)")
def type_fits(spark, sf_dir):
    rows = spark.createDataFrame([("string", "NVARCHAR(50)"), ("integer", "decimal(9,2)"), ("number", "decimal(9,2)"), ("blob", "int")], "logical string, sql string")
    return rows.withColumn("fits", catalog.type_fits(F.col("logical"), F.col("sql")))


SCRIPT = "CREATE TABLE dbo.Orders (id int NOT NULL, total decimal(9,2), cust int REFERENCES dbo.Customers, CONSTRAINT c CHECK (total > 0))\nGO\nCREATE PROCEDURE [dbo].[pLoad] AS EXEC sp_executesql N'x'\nGO\nSELECT 1"


@case("sql_batches", "SELECT * FROM (VALUES (0, 'table', 'dbo.Orders', 'fk:dbo.customers,check'), (1, 'procedure', 'dbo.pLoad', 'dynamic_sql'), (2, 'statement', '', '')) AS t(pos, kind, name, tags)")
def sql_batches(spark, sf_dir):
    found = S.sql_batches(spark.createDataFrame([("a.sql", SCRIPT)], "file string, text string"))
    return found.select("pos", "kind", "name", F.concat_ws(",", "tags").alias("tags"))


@case("ddl_columns", "SELECT * FROM (VALUES ('dbo.Orders', 'id', 'int', FALSE), ('dbo.Orders', 'total', 'decimal', TRUE), ('dbo.Orders', 'cust', 'int', TRUE)) AS t(\"table\", \"column\", type, nullable)")
def ddl_columns(spark, sf_dir):
    return S.create_table_columns(S.sql_batches(spark.createDataFrame([("a.sql", SCRIPT)], "file string, text string")))


@case("code_chunks", "SELECT * FROM (VALUES ('load', 'def', 'read'), ('Store', 'class', ''), ('open', 'def', 'load')) AS t(name, kind, calls)")
def code_chunks(spark, sf_dir):
    code = "import os\ndef load(x):\n    return read(x)\nclass Store:\n    def open(self):\n        return load(1)\n"
    found = S.code_chunks(spark.createDataFrame([("a.py", code)], "file string, text string"))
    return found.select("name", "kind", F.concat_ws(",", "calls").alias("calls"))


@case("openapi_operations", "SELECT * FROM (VALUES ('/pets', 'get', 'listPets'), ('/pets', 'post', 'addPet')) AS t(path, method, operation_id)")
def openapi_operations(spark, sf_dir):
    text = '{"paths": {"/pets": {"get": {"operationId": "listPets"}, "post": {"operationId": "addPet"}}}}'
    return S.openapi_operations(spark.createDataFrame([("a.json", text)], "file string, text string")).drop("file")


@case("markdown_sections", "SELECT * FROM (VALUES (1, 'Goals', 'Be fast.'), (2, 'Scope', '')) AS t(level, heading, body)")
def markdown_sections(spark, sf_dir):
    found = S.markdown_requirements(spark.createDataFrame([("a.md", "intro\n# Goals\nBe fast.\n## Scope\n")], "file string, text string"))
    return found.select("level", "heading", "body")


@case("transcript_frames", "SELECT * FROM (VALUES ('a.mp3::seg_0000001500', 'start:1.50')) AS t(doc_id, tag)")
def transcript_frames(spark, sf_dir):
    rows = spark.createDataFrame([("/in/a.mp3", 1.5, 3.0, "hello"), ("/in/a.mp3", 3.0, 4.0, " ")], "file string, start double, end double, text string")
    return S.transcript_frames(rows).select("doc_id", F.element_at("tags", 1).alias("tag"))


@case("procedure_facts", "SELECT * FROM (VALUES ('p', 'parameter', '@id'), ('p', 'json', 'order.id'), ('p', 'changes', 'Orders'), ('p', 'literal', 'open'), ('p', 'error', '50001')) AS t(name, kind, value)")
def procedure_facts(spark, sf_dir):
    body = "CREATE PROC p @id int AS UPDATE dbo.Orders SET s = JSON_VALUE(@j, '$.order.id') WHERE state = 'open'; THROW 50001, 'x', 1"
    return S.procedure_facts(spark.createDataFrame([("p", body)], "name string, body string"))


@case("name_forms", "SELECT * FROM (VALUES (1::BIGINT, 'user_name userName UserName', 'category', '/v1/users/{}'), (2, '', 'status', '/a')) AS t(id, spellings, singular, path)")
def name_forms(spark, sf_dir):
    from mnemospark.functions import text as T

    rows = spark.createDataFrame([(1, ["user", "name"], "categories", "V1//users/:id/"), (2, ["x"], "status", "/a")], "id long, words array<string>, name string, path string")
    return rows.select("id", F.concat_ws(" ", T.spellings(F.col("words"))).alias("spellings"), T.singular(F.col("name")).alias("singular"), T.normal_path(F.col("path")).alias("path"))


@case("language_filter", "SELECT * FROM (VALUES (1::BIGINT), (3)) AS t(id)")
def language_filter(spark, sf_dir):
    from mnemospark.operators.frames import for_language

    rows = [(1, "Python", "go", None), (2, None, "go", "python"), (3, None, None, None)]
    return for_language(spark.createDataFrame(rows, "id long, tag_lang string, body_lang string, edits_lang string"), "python").select("id")


@pytest.mark.parametrize("name", sorted(CASES))
def test_typed_rows(spark, name):
    function, answer = CASES[name]
    assert rows_of(function(spark, None)) == expected(duckdb.connect(), answer)
