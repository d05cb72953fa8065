"""Queries over texts: scans, statistics, search, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import text as op
from .registry import query
from .tables import TOKENS_SQL, build_index, table, text_index

QUERY = "the license version worthless licensed the"
TERMS = list(dict.fromkeys(QUERY.split()))
IN_TERMS = "(" + ", ".join(f"'{t}'" for t in TERMS) + ")"
WORDS_SQL = r"list_transform(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+'), lambda w: regexp_replace(w, '[!-/:-@\[-`{-~]+$', ''))"
LEX_SQL = "WITH " + TOKENS_SQL + f""",
sizes AS (SELECT d.doc_id, count(DISTINCT t.term) AS length FROM documents d LEFT JOIN tokens t USING (doc_id) GROUP BY d.doc_id),
totals AS (SELECT count(*) AS n_docs, greatest(avg(length), 1.0) AS mean_length FROM sizes),
hits AS (SELECT doc_id, term, count(*) AS tf FROM tokens WHERE term IN {IN_TERMS} GROUP BY doc_id, term),
dfs AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
lex AS (SELECT h.doc_id, h.term, h.tf, s.length, t.n_docs, t.mean_length, ln((t.n_docs + 1) / (f.df + 1)) + 1 AS idf,
        CASE h.term WHEN 'the' THEN 2 ELSE 1 END AS times FROM hits h JOIN dfs f USING (term) JOIN sizes s USING (doc_id) CROSS JOIN totals t),
bm AS (SELECT doc_id, sum(times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))) AS score FROM lex GROUP BY doc_id)
"""


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("term_freq", "WITH " + TOKENS_SQL + "SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY doc_id, term")
def term_freq(spark, sf_dir):
    return op.term_freq(docs(spark, sf_dir))


@query("tokenize", "WITH " + TOKENS_SQL + "SELECT doc_id, count(*) AS n, count(DISTINCT term) AS n_distinct FROM tokens GROUP BY doc_id")
def tokenize(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("t")).filter(F.size("t") > 0)
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query("postings", "WITH " + TOKENS_SQL + "SELECT term, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM tokens GROUP BY term")
def postings(spark, sf_dir):
    return op.term_freq(docs(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query(
    "word_idf",
    f"""WITH w AS (SELECT DISTINCT doc_id, unnest({WORDS_SQL}) AS word FROM documents),
    f AS (SELECT word, count(*) AS df FROM w WHERE strlen(word) >= 3 GROUP BY word)
    SELECT word, df, round(ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1, 6) AS idf FROM f""",
)
def word_idf(spark, sf_dir):
    return op.word_idf(docs(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


@query("bm25", LEX_SQL + "SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, doc_id LIMIT 10")
def bm25(spark, sf_dir):
    rows = op.bm25(docs(spark, sf_dir), QUERY).withColumn("score", F.round("score", 6))
    return op.top(rows, 10, F.col("score").desc(), "doc_id")


@query("bm25_all", LEX_SQL + "SELECT doc_id, round(score, 6) AS score FROM bm")
def bm25_all(spark, sf_dir):
    return op.bm25(docs(spark, sf_dir), QUERY).withColumn("score", F.round("score", 6))


@query("bm25_indexed", LEX_SQL + "SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, doc_id LIMIT 10")
def bm25_indexed(spark, sf_dir):
    rows = op.bm25(text_index(spark, sf_dir), QUERY).withColumn("score", F.round("score", 6))
    return op.top(rows, 10, F.col("score").desc(), "doc_id")


@query("index_build", "WITH " + TOKENS_SQL + "SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM tokens GROUP BY term")
def index_build(spark, sf_dir):
    """A new index; what its blocks hold, by term."""
    postings, _ = build_index(spark, sf_dir).contents()
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("tf"))


@query(
    "index_postings",
    r"""WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS words FROM documents),
    t AS (SELECT doc_id, unnest(words) AS term, generate_subscripts(words, 1) - 1 AS pos FROM w)
    SELECT term, doc_id, count(*)::INTEGER AS tf, (count(*) OVER (PARTITION BY doc_id))::INTEGER AS length, sum(pos)::BIGINT AS pos_sum, max(pos)::INTEGER AS last FROM t GROUP BY term, doc_id""",
)
def index_postings(spark, sf_dir):
    postings, _ = text_index(spark, sf_dir).contents()
    total = F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a + x)
    return postings.select("term", "doc_id", "tf", "length", total.alias("pos_sum"), F.array_max("positions").alias("last"))


@query(
    "index_trigrams",
    """WITH t AS (SELECT DISTINCT doc_id, substr(low, k::BIGINT, 3) AS tri
      FROM (SELECT doc_id, low, unnest(range(1, length(low) - 1)) AS k FROM (SELECT doc_id, lower(text) AS low FROM documents)))
    SELECT tri, count(*) AS df, sum(doc_id)::BIGINT AS id_sum FROM t GROUP BY tri""",
)
def index_trigrams(spark, sf_dir):
    _, trigrams = text_index(spark, sf_dir).contents()
    return trigrams.groupBy("tri").agg(F.count("*").alias("df"), F.sum("doc_id").alias("id_sum"))


@query("index_prefix", "WITH " + TOKENS_SQL + "SELECT term, doc_id, count(*) AS tf FROM tokens WHERE starts_with(term, 'lic') GROUP BY ALL")
def index_prefix(spark, sf_dir):
    return text_index(spark, sf_dir).postings_with("lic").select("term", "doc_id", "tf")


@query(
    "index_phrase",
    r"""WITH w AS (SELECT doc_id, unnest(words) AS term, generate_subscripts(words, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS words FROM documents))
    SELECT a.doc_id, count(*) AS n FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN w c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2
    WHERE a.term = 'under' AND b.term = 'the' AND c.term = 'apache' GROUP BY 1""",
)
def index_phrase(spark, sf_dir):
    return text_index(spark, sf_dir).phrase(["under", "the", "apache"])


@query("topk", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def topk(spark, sf_dir):
    return op.top(docs(spark, sf_dir).select("doc_id", "n_chars"), 25, F.col("n_chars").desc(), "doc_id")


@query("topk_batch", "SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INTEGER AS rank FROM documents QUALIFY rank <= 3")
def topk_batch(spark, sf_dir):
    return op.top_per(docs(spark, sf_dir).select("source", "doc_id", "n_chars"), "source", 3, F.col("n_chars").desc(), "doc_id")


GREP = "SELECT doc_id, ((length(lower(text)) - length(replace(lower(text), '{0}', ''))) / {1})::BIGINT AS n FROM documents WHERE contains(lower(text), '{0}')"


@query("grep_count", GREP.format("license", 7))
def grep_count(spark, sf_dir):
    return op.grep(docs(spark, sf_dir), "license")


@query("search_all_instances", GREP.format("and the", 7))
def search_all_instances(spark, sf_dir):
    return op.grep(docs(spark, sf_dir), "And The")


@query("search_exact", "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE contains(lower(text), 'apache license')")
def search_exact(spark, sf_dir):
    return docs(spark, sf_dir).filter(F.lower("text").contains("apache license")).select("doc_id", F.lit(1.0).alias("score"))


@query("trigram_candidates", "SELECT doc_id FROM documents WHERE contains(lower(text), 'lic') AND contains(lower(text), 'ice') AND contains(lower(text), 'cen') AND contains(lower(text), 'ens') AND contains(lower(text), 'nse')")
def trigram_candidates(spark, sf_dir):
    return op.trigram_candidates(docs(spark, sf_dir), "License")


@query("trigrams_indexed", "SELECT doc_id FROM documents WHERE contains(lower(text), 'lic') AND contains(lower(text), 'ice') AND contains(lower(text), 'cen') AND contains(lower(text), 'ens') AND contains(lower(text), 'nse')")
def trigrams_indexed(spark, sf_dir):
    return op.trigram_candidates(docs(spark, sf_dir), "License", text_index(spark, sf_dir))


@query("grep_lines", r"SELECT doc_id, i::INTEGER AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE regexp_matches(line, '[Ll]icensed? under')")
def grep_lines(spark, sf_dir):
    return op.grep_lines(docs(spark, sf_dir), "[Ll]icensed? under")


@query("contains_token", r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])version([^a-z0-9]|$)')")
def contains_token(spark, sf_dir):
    return docs(spark, sf_dir).filter(T.contains_token(F.col("text"), "Version")).select("doc_id")


@query("looks_like_code", r"""SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM documents)
  WHERE regexp_matches(w, '^\d{5,10}$') AND NOT regexp_matches(w, '^(19|20)\d{2}\d{2}\d{2}$') GROUP BY doc_id""")
def looks_like_code(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.explode(T.words(F.col("text"))).alias("w"))
    return rows.filter(T.looks_like_code(F.col("w"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("posting_intersect", "WITH " + TOKENS_SQL + "SELECT doc_id FROM tokens WHERE term IN ('license', 'version', 'the') GROUP BY doc_id HAVING count(DISTINCT term) = 3")
def posting_intersect(spark, sf_dir):
    return op.holding_all(docs(spark, sf_dir), ["license", "version", "the"])


@query("posting_union", "WITH " + TOKENS_SQL + "SELECT DISTINCT doc_id FROM tokens WHERE term IN ('license', 'idiot')")
def posting_union(spark, sf_dir):
    return op.holding_any(docs(spark, sf_dir), ["license", "idiot"])


@query("posting_except", "WITH " + TOKENS_SQL + "SELECT DISTINCT doc_id FROM tokens WHERE term = 'the' EXCEPT SELECT doc_id FROM tokens WHERE term = 'and'")
def posting_except(spark, sf_dir):
    d = docs(spark, sf_dir)
    return op.holding_any(d, ["the"]).exceptAll(op.holding_any(d, ["and"]))


@query("chunk_text_512", """
WITH s AS (SELECT doc_id, text, greatest(0, ceil((length(text) - 512) / 256.0))::BIGINT AS last FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, text, unnest(range(0, last + 1)) AS i FROM s),
c AS (SELECT doc_id, i::INTEGER AS pos, substr(text, i * 256 + 1, 512) AS part, strlen(trim(substr(text, i * 256 + 1, 512), ' ')) >= 50 AS big FROM w),
k AS (SELECT *, max(big::INTEGER) OVER (PARTITION BY doc_id) AS found FROM c)
SELECT doc_id, pos, md5(part) AS part FROM k WHERE big UNION ALL SELECT doc_id, 0, md5((SELECT text FROM documents d WHERE d.doc_id = k.doc_id)) FROM k WHERE found = 0 AND pos = 0""")
def chunk_text_512(spark, sf_dir):
    rows = docs(spark, sf_dir).filter("text is not null").select("doc_id", F.explode(T.char_windows(F.col("text"))).alias("w"))
    return rows.select("doc_id", "w.pos", F.md5("w.part").alias("part"))


@query("chunk_words", r"""
WITH s AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, ws, unnest(range(0, greatest(0, ceil((len(ws) - 512) / 256.0))::BIGINT + 1)) AS i FROM s)
SELECT doc_id, i::INTEGER AS pos, md5(array_to_string(ws[i * 256 + 1 : i * 256 + 512], ' ')) AS part FROM w""")
def chunk_words(spark, sf_dir):
    rows = docs(spark, sf_dir).filter("text is not null").select("doc_id", F.explode(T.word_windows(F.col("text"))).alias("w"))
    return rows.select("doc_id", "w.pos", F.md5("w.part").alias("part"))


@query("dedup_exact", "SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def dedup_exact(spark, sf_dir):
    return op.dedup_exact(docs(spark, sf_dir))


@query("content_dedup", r"""
SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang, lower(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k = 1""")
def content_dedup(spark, sf_dir):
    hits = docs(spark, sf_dir).select("lang", "doc_id", "text", F.col("n_chars").alias("conf"))
    return op.content_dedup(hits, "lang").select("lang", "doc_id")


@query("stopwords", "WITH " + TOKENS_SQL + "SELECT doc_id, count(*) AS n FROM tokens WHERE term NOT IN (" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + ") GROUP BY doc_id")
def stopwords(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.size(T.without(T.tokens(F.col("text")), T.STOPWORDS)).cast("long").alias("n"))
    return rows.filter("n > 0")


@query("levenshtein", "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name)::INTEGER AS d FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def levenshtein(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_nationkey").alias("x"), F.col("n_name").alias("a")), n.select(F.col("n_nationkey").alias("y"), F.col("n_name").alias("b"))
    return a.join(F.broadcast(b), F.col("x") < F.col("y")).select("a", "b", F.levenshtein("a", "b").alias("d"))  # nation has 25 rows at every scale


@query("extract_entities", r"""WITH e AS (SELECT doc_id, unnest(list_distinct(list_concat(regexp_extract_all(text, '\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)+'), regexp_extract_all(text, '\(([^()]{2,60})\)', 1)))) AS entity FROM documents)
  SELECT entity, count(*) AS n FROM e GROUP BY entity""")
def extract_entities(spark, sf_dir):
    return docs(spark, sf_dir).select(F.explode(T.entities(F.col("text"))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))


@query("recall_context", "SELECT doc_id, substr(text, greatest(1, strpos(lower(text), 'license') - 40), strpos(lower(text), 'license') + 7 + 40 - greatest(1, strpos(lower(text), 'license') - 40)) AS context FROM documents WHERE contains(lower(text), 'license')")
def recall_context(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.snippet(F.col("text"), "license").alias("context")).filter("context is not null")


@query("normalize_unicode", "SELECT doc_id, md5(translate(text, '–—‐‘’“”', '---''''\"\"')) AS h FROM documents")
def normalize_unicode(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.normalized(F.col("text"))).alias("h"))


@query("task_identity", r"SELECT doc_id, substr(sha256(lower(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'), ' '))), 1, 16) AS task FROM documents")
def task_identity(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.task_hash(F.col("text")).alias("task"))


@query("token_bigrams", "WITH " + TOKENS_SQL + ", d AS (SELECT DISTINCT doc_id, term FROM tokens), b AS (SELECT doc_id, term, lead(term) OVER (PARTITION BY doc_id ORDER BY term) AS next FROM d) SELECT term || ' ' || next AS gram, count(*) AS n FROM b WHERE next IS NOT NULL GROUP BY 1")
def token_bigrams(spark, sf_dir):
    pairs = T.ngrams(F.array_sort(F.array_distinct(T.tokens(F.col("text")))), 2)
    grams = docs(spark, sf_dir).select(F.explode(pairs).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


@query("phrase_boost", r"""WITH d AS (SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') AS t FROM documents)
  SELECT doc_id, CASE WHEN contains(t, 'licensed under the apache') OR contains(t, 'under the apache license') THEN 1.25 WHEN contains(t, 'licensed under the') OR contains(t, 'under the apache') OR contains(t, 'the apache license') THEN 1.15 ELSE 1.0 END::DOUBLE AS boost FROM d""")
def phrase_boost(spark, sf_dir):
    return op.phrase_boost(docs(spark, sf_dir), "licensed under the apache license")


PAGES_SQL = "pages0 AS (SELECT source, doc_id AS page, 'Header of ' || source || chr(10) || text || chr(10) || ' COPY ' AS text FROM documents WHERE text IS NOT NULL)"


def _paged(spark, sf_dir):
    body = F.concat(F.lit("Header of "), "source", F.lit("\n"), "text", F.lit("\n COPY "))
    return docs(spark, sf_dir).filter("text is not null").select("source", F.col("doc_id").alias("page"), body.alias("text"))


@query("strip_headers", "WITH " + PAGES_SQL + " SELECT page, md5(ltrim(substr(text, length('Header of ' || source) + 2), ' ')) AS h FROM pages0")
def strip_headers(spark, sf_dir):
    return op.strip_headers(_paged(spark, sf_dir)).select("page", F.md5("text").alias("h"))


@query("strip_watermark_lines", "WITH " + PAGES_SQL + """, l AS (SELECT source, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM pages0),
  r AS (SELECT source, trim(line, ' ') AS line FROM l WHERE strlen(trim(line, ' ')) BETWEEN 1 AND 40 AND len(string_split_regex(trim(line, ' '), ' +')) <= 4
        GROUP BY 1, 2 HAVING count(DISTINCT page) >= floor(0.6 * (SELECT count(*) FROM pages0 p WHERE p.source = l.source)))
  SELECT page, md5(coalesce(string_agg(l.line, chr(10) ORDER BY i) FILTER (WHERE r.line IS NULL), '')) AS h FROM l LEFT JOIN r ON l.source = r.source AND trim(l.line, ' ') = r.line GROUP BY page""")
def strip_watermark_lines(spark, sf_dir):
    pages = _paged(spark, sf_dir)
    return op.strip_lines(pages, op.repeated_page_lines(pages)).select("page", F.md5("text").alias("h"))


@query("pages_host_pointer", r"SELECT page_id, 'page:' || substr(sha256(url), 1, 16) AS doc_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host FROM pages WHERE url IS NOT NULL")
def pages_host_pointer(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").filter("url is not null")
    return pages.select("page_id", F.concat(F.lit("page:"), F.substring(F.sha2("url", 256), 1, 16)).alias("doc_id"), F.parse_url("url", F.lit("HOST")).alias("host"))


@query("json_props", "SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events WHERE props IS NOT NULL")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("props is not null").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("hash_embed")
def hash_embed(spark, sf_dir):
    from ..functions.stem import hash_encoder

    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(hash_encoder(16)(T.tokens(F.col("text")))).alias("d", "x"))
    return rows.withColumn("x", F.round("x", 6))


@query(
    "concept_links",
    r"""WITH m AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\p{Lu}[\p{L}\p{N}_]+(?: \p{Lu}[\p{L}\p{N}_]+)+|\b[A-Z]{2,}-?\d+\b'), lambda x: lower(x)) AS c FROM documents),
    e AS (SELECT doc_id, unnest(c) AS concept, generate_subscripts(c, 1) AS i FROM m), f AS (SELECT doc_id, concept, min(i) AS i FROM e GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f)
    SELECT concept, count(DISTINCT doc_id) AS n FROM r WHERE k <= 12 GROUP BY concept HAVING count(DISTINCT doc_id) BETWEEN 2 AND 40""",
)
def concept_links(spark, sf_dir):
    from ..functions.stem import concepts
    from ..operators.graph import list_concepts

    links = docs(spark, sf_dir).select("doc_id", F.explode(concepts(F.col("text"))).alias("concept"))
    return list_concepts(links, 2, 40)


@query("focused_passages")
def focused_passages(spark, sf_dir):
    from ..functions.stem import focused

    cut = focused({"license": 3.0, "version": 2.0})
    return docs(spark, sf_dir).select("doc_id", F.posexplode(cut(F.col("text"))).alias("pos", "passage"))
