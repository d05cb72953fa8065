"""Queries that rank, fuse and gate hits.

Where a query needs hits of several engines they are made from ``documents``: the query is the
id modulo seven, the confidence follows from the length.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import recall
from ..operators import retrieval as op
from ..operators import text as X
from ..operators import vectors as W
from .registry import query
from .tables import table, text_index
from .text_queries import LEX_SQL, QUERY
from .vector_queries import V_SQL

H_SQL = """
h AS (SELECT doc_id % 7 AS query_id, doc_id, round(least(n_chars, 20000) / 20000.0::DOUBLE, 6) AS conf,
      CASE doc_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'semantic' ELSE 'symbol' END AS engine FROM documents)
"""
WITH = "WITH " + H_SQL


def hits(spark, sf_dir):
    conf = F.round(F.least("n_chars", F.lit(20000)) / 20000.0, 6)
    engine = F.when(F.col("doc_id") % 3 == 0, "text").when(F.col("doc_id") % 3 == 1, "semantic").otherwise("symbol")
    return table(spark, sf_dir, "documents").select((F.col("doc_id") % 7).alias("query_id"), "doc_id", conf.alias("conf"), engine.alias("engine"))


@query(
    "candidate_merge",
    WITH + """, m AS (SELECT query_id, doc_id // 2 AS doc_id, conf, engine FROM h)
    SELECT query_id, doc_id, max(conf) AS conf, arg_max(engine, struct_pack(c := conf, e := engine)) AS engine FROM m GROUP BY 1, 2""",
)
def candidate_merge(spark, sf_dir):
    h = hits(spark, sf_dir).withColumn("doc_id", F.floor(F.col("doc_id") / 2))
    return op.candidate_merge(*[h.filter(F.col("engine") == e) for e in ("text", "semantic", "symbol")])


@query(
    "rrf",
    WITH + """, a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY conf DESC, doc_id) - 1 AS rank, conf AS weight FROM h),
    b AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id DESC) - 1 AS rank FROM h WHERE engine = 'text')
    SELECT query_id, doc_id, round(sum(p), 6) AS score FROM (SELECT query_id, doc_id, weight / (60 + rank) AS p FROM a UNION ALL SELECT query_id, doc_id, 1.0 / (60 + rank) FROM b) GROUP BY 1, 2""",
)
def rrf(spark, sf_dir):
    h = hits(spark, sf_dir)
    a = h.withColumn("rank", F.row_number().over(op._by_query(F.col("conf").desc(), "doc_id")) - 1).withColumn("weight", F.col("conf"))
    b = h.filter("engine = 'text'").drop("conf").withColumn("rank", F.row_number().over(op._by_query(F.col("doc_id").desc())) - 1)
    return op.rrf(a, b).withColumn("score", F.round("score", 6))


@query(
    "inject",
    WITH + """, s AS (SELECT query_id, doc_id, 1 + doc_id % 2 AS mentions FROM h WHERE doc_id % 10 = 0), x AS (SELECT query_id, doc_id, conf FROM h WHERE doc_id % 20 <> 0),
    t AS (SELECT query_id, max(conf) AS top FROM x GROUP BY 1)
    SELECT query_id, doc_id, round(CASE WHEN conf IS NULL THEN 0.8::DOUBLE * top ELSE conf + coalesce(mentions, 0) * 0.2::DOUBLE * top END, 6) AS score FROM x FULL JOIN s USING (query_id, doc_id) JOIN t USING (query_id)""",
)
def inject(spark, sf_dir):
    h = hits(spark, sf_dir)
    specific = h.filter("doc_id % 10 = 0").select("query_id", "doc_id", (1 + F.col("doc_id") % 2).alias("mentions"))
    return op.inject(h.filter("doc_id % 20 <> 0").select("query_id", "doc_id", F.col("conf").alias("score")), specific).withColumn("score", F.round("score", 6))


@query(
    "smart_gate",
    WITH + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY engine = 'text' DESC, conf DESC, doc_id)::INTEGER AS rank, count(*) FILTER (WHERE engine = 'text') OVER (PARTITION BY query_id) AS n FROM h)
    SELECT query_id, doc_id, rank FROM r WHERE rank <= greatest(n, 60)""",
)
def smart_gate(spark, sf_dir):
    h = hits(spark, sf_dir).select("query_id", "doc_id", F.col("conf").alias("score"), (F.col("engine") == "text").alias("lexical"))
    return op.smart_gate(h, 60).select("query_id", "doc_id", "rank")


@query(
    "relative_cutoff",
    WITH + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY conf DESC, doc_id)::INTEGER AS rank, max(conf) OVER (PARTITION BY query_id) AS top FROM h)
    SELECT query_id, doc_id, rank FROM r WHERE rank <= 3 OR conf >= 0.3::DOUBLE * top""",
)
def relative_cutoff(spark, sf_dir):
    return op.relative_cutoff(hits(spark, sf_dir)).select("query_id", "doc_id", "rank")


@query(
    "abstain",
    WITH + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY conf DESC, doc_id) AS rank, max(conf) OVER (PARTITION BY query_id) AS top FROM h WHERE engine = 'semantic' OR doc_id % 5 = 0),
    k AS (SELECT * FROM r WHERE rank = 1 OR engine <> 'semantic' OR (conf >= 0.05::DOUBLE AND (rank <= 10 OR top - conf <= 0.2::DOUBLE))),
    s AS (SELECT *, count(*) FILTER (WHERE engine = 'semantic') OVER q AS n, avg(conf) FILTER (WHERE engine = 'semantic') OVER q AS mean, stddev_pop(conf) FILTER (WHERE engine = 'semantic') OVER q AS dev,
          max(CASE WHEN engine <> 'semantic' THEN conf ELSE 0 END) OVER q >= 0.55::DOUBLE AS sure FROM k WINDOW q AS (PARTITION BY query_id))
    SELECT query_id, doc_id, conf, engine FROM s WHERE NOT (n >= 4 AND NOT sure AND (CASE WHEN dev > 0 THEN (top - mean) / dev ELSE 0 END) < 1)""",
)
def abstain(spark, sf_dir):
    return op.abstain(hits(spark, sf_dir).filter("engine = 'semantic' or doc_id % 5 = 0"))


@query(
    "passage_blend",
    WITH + """, p AS (SELECT query_id, doc_id // 5 AS doc_id, conf FROM h),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY conf DESC) AS k FROM p),
    b AS (SELECT query_id, doc_id, max(conf) AS best, count(*) AS n, sum(conf) FILTER (WHERE k <= 3) AS top3 FROM r GROUP BY 1, 2)
    SELECT query_id, doc_id, round(greatest(0.5::DOUBLE, 0.25::DOUBLE + 0.5::DOUBLE * best + 0.5::DOUBLE * n + 0.05::DOUBLE * top3), 6) AS score FROM b""",
)
def passage_blend(spark, sf_dir):
    p = hits(spark, sf_dir).select("query_id", F.floor(F.col("doc_id") / 5).alias("doc_id"), F.col("conf").alias("score"))
    whole = p.select("query_id", "doc_id").distinct().withColumn("own", F.lit(0.5))
    return op.passage_blend(whole, p).withColumn("score", F.round("score", 6))


LEXICAL = LEX_SQL + ", q AS (SELECT greatest(sum(idf), 1.0) AS whole FROM (SELECT DISTINCT term, idf FROM lex)), share AS (SELECT doc_id, sum(idf) / (SELECT whole FROM q) AS lex FROM lex GROUP BY doc_id)"


@query("pure_lexical", LEXICAL + "SELECT doc_id, round(lex, 6) AS score FROM share")
def pure_lexical(spark, sf_dir):
    return X.lexical_share(table(spark, sf_dir, "documents"), QUERY).withColumn("score", F.round("score", 6))


def _semantic(spark, sf_dir):
    """Documents against vector 0: a document's vector is the one of its id."""
    rows = table(spark, sf_dir, "embeddings")
    prints = W.fingerprints(rows, W.dimension_stats(rows)).select("vec_id", "fp")
    first = prints.filter("vec_id = 0").select(F.col("fp").alias("q"))
    return prints.crossJoin(F.broadcast(first)).select(F.lit(0).alias("query_id"), F.col("vec_id").alias("doc_id"), (1 - V.hamming(F.col("fp"), F.col("q")) / 64.0).alias("sem"))  # one row


SEM_SQL = "," + V_SQL + ", sem AS (SELECT c.vec_id AS doc_id, 1 - bit_count(xor(c.fp, q.fp)) / 64.0::DOUBLE AS sem FROM fps c JOIN fps q ON q.vec_id = 0)"


@query(
    "hybrid",
    LEXICAL + SEM_SQL + """, j AS (SELECT doc_id, CASE WHEN lex IS NOT NULL THEN 0.60::DOUBLE * sem + 0.40::DOUBLE * lex ELSE 0.24 END AS score, lex IS NOT NULL AS lexical, CASE WHEN lex IS NOT NULL THEN sem ELSE 0 END AS sem FROM sem LEFT JOIN share USING (doc_id)),
    r AS (SELECT *, row_number() OVER (ORDER BY lexical DESC, round(score, 6) DESC, doc_id) AS k, count(*) FILTER (WHERE lexical) OVER () AS n FROM j)
    SELECT doc_id, round(score, 6) AS score, round(sem, 6) AS sem FROM r WHERE k <= greatest(n, 50)""",
)
def hybrid(spark, sf_dir):
    lexical = X.lexical_share(text_index(spark, sf_dir), QUERY).select(F.lit(0).alias("query_id"), "doc_id", F.col("score").alias("lex"))
    found = op.hybrid(_semantic(spark, sf_dir), lexical)
    return found.select("doc_id", F.round("score", 6).alias("score"), F.round("sem", 6).alias("sem"))


def _postings(spark, sf_dir):
    s = X.lexical_stats(text_index(spark, sf_dir), QUERY.split()).withColumn("idf", F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).withColumn("query_id", F.lit(0))
    asked = s.select("term", "idf").distinct().agg(F.avg("idf").alias("idf_mean"), (F.count_if(F.col("idf") > 2.5) / F.count("*")).alias("rare_share"))
    return s.crossJoin(F.broadcast(asked))  # one row


FULL_SQL = LEX_SQL + SEM_SQL + """, a AS (SELECT avg(idf) AS m, count(*) FILTER (WHERE idf > 2.5) / count(*)::DOUBLE AS rr FROM (SELECT DISTINCT term, idf FROM lex)),
e0 AS (SELECT m, least(greatest(0.7::DOUBLE * least(greatest((m - 1.2::DOUBLE) / 1.2::DOUBLE, 0), 1) + 0.3::DOUBLE * rr, 0), 1) AS e FROM a),
w AS (SELECT l.*, e, m, tf * (1.5 + 1.5 * (1 - e)) / (tf + 1.5 + 1.5 * (1 - e)) * pow(idf, 1 + 0.15::DOUBLE * e) AS w FROM lex l CROSS JOIN e0),
b AS (SELECT doc_id, sum(CASE WHEN idf > 2.5 THEN w ELSE 0 END) AS rare, sum(CASE WHEN idf > 2.5 THEN 0 ELSE w END) AS common, avg(idf) AS overlap, any_value(e) AS e, any_value(m) AS m, any_value(length) AS length, any_value(mean_length) AS mean_length FROM w GROUP BY doc_id),
r AS (SELECT *, least(((0.6::DOUBLE + 0.15::DOUBLE * e) * rare + (0.4::DOUBLE - 0.15::DOUBLE * e) * common) / 10, 1) AS r FROM b),
x AS (SELECT doc_id, r * (1 + r * r) / greatest(0.65::DOUBLE + 0.35::DOUBLE * length / mean_length, 0.5) AS lex,
      least(greatest(least(1 - overlap / greatest(m, 0.001), 1), 0) + CASE WHEN e < 0.3 THEN least(0.35::DOUBLE * (1 - e), 0.35) ELSE 0 END, 1) AS alpha FROM r)
"""


@query("full_hybrid", FULL_SQL + "SELECT doc_id, round(coalesce(alpha, 1) * sem + (1 - coalesce(alpha, 1)) * coalesce(lex, 0), 6) AS score FROM sem LEFT JOIN x USING (doc_id)")
def full_hybrid(spark, sf_dir):
    return op.full_hybrid(_postings(spark, sf_dir), _semantic(spark, sf_dir)).select("doc_id", F.round("score", 6).alias("score"))


@query("champions", FULL_SQL + "SELECT doc_id, round(coalesce(alpha, 1) * sem + (1 - coalesce(alpha, 1)) * coalesce(lex, 0), 6) AS score FROM (SELECT * FROM sem ORDER BY sem DESC, doc_id LIMIT 50) LEFT JOIN x USING (doc_id)")
def champions(spark, sf_dir):
    return op.champions(_postings(spark, sf_dir), _semantic(spark, sf_dir)).select("doc_id", F.round("score", 6).alias("score"))


@query(
    "hybrid_float",
    LEX_SQL + SEM_SQL + """, w AS (SELECT doc_id, sum(CASE WHEN idf > 2.5 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END * idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * greatest(0.65::DOUBLE + 0.35::DOUBLE * length / mean_length, 0.5))) AS t FROM lex GROUP BY doc_id)
    SELECT doc_id, round(0.5 * sem + 0.5 * least(coalesce(t, 0) / 10, 1) * (1 + least(coalesce(t, 0) / 10, 1) * least(coalesce(t, 0) / 10, 1)), 6) AS score FROM sem LEFT JOIN w USING (doc_id) WHERE sem > 0 OR t > 0""",
)
def hybrid_float(spark, sf_dir):
    return op.float_hybrid(_postings(spark, sf_dir), _semantic(spark, sf_dir)).select("doc_id", F.round("score", 6).alias("score"))


@query(
    "ndcg",
    """WITH r AS (SELECT doc_id % 5 AS query_id, doc_id, n_chars, row_number() OVER (PARTITION BY doc_id % 5 ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents),
    q AS (SELECT doc_id % 5 AS query_id, doc_id, 2 * quality + (1 - toxic) AS rel FROM labels),
    d AS (SELECT query_id, sum((pow(2.0, rel) - 1) / log2(rank + 2)) AS dcg FROM r JOIN q USING (query_id, doc_id) WHERE rank < 10 GROUP BY 1),
    b AS (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) - 1 AS rank FROM q WHERE rel > 0),
    i AS (SELECT query_id, sum((pow(2.0, rel) - 1) / log2(rank + 2)) AS ideal FROM b WHERE rank < 10 GROUP BY 1)
    SELECT query_id, round(coalesce(dcg, 0) / ideal, 6) AS ndcg FROM i LEFT JOIN d USING (query_id)""",
)
def ndcg(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").select((F.col("doc_id") % 5).alias("query_id"), "doc_id", F.col("n_chars").alias("score"))
    qrels = table(spark, sf_dir, "labels").select((F.col("doc_id") % 5).alias("query_id"), "doc_id", (2 * F.col("quality") + 1 - F.col("toxic")).alias("rel"))
    return op.ndcg(hits, qrels).withColumn("ndcg", F.round("ndcg", 6))


@query(
    "needle",
    WITH + """, k AS (SELECT doc_id % 7 AS query_id, doc_id, ((length(lower(text)) - length(replace(lower(text), 'license', ''))) / 7)::BIGINT AS n FROM documents WHERE contains(lower(text), 'license'))
    SELECT query_id, doc_id, round(coalesce(conf, 0) + 1000 * coalesce(n, 0), 6) AS score FROM h FULL JOIN k USING (query_id, doc_id)""",
)
def needle(spark, sf_dir):
    found = X.grep(table(spark, sf_dir, "documents"), "license").withColumn("query_id", F.col("doc_id") % 7)
    return op.needle(hits(spark, sf_dir).select("query_id", "doc_id", F.col("conf").alias("score")), found).withColumn("score", F.round("score", 6))


@query(
    "federated",
    WITH + """, b AS (SELECT query_id, doc_id // 3 AS doc_id, max(conf) AS score FROM h GROUP BY 1, 2)
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM b QUALIFY rank <= 5""",
)
def federated(spark, sf_dir):
    h = hits(spark, sf_dir).select("query_id", F.floor(F.col("doc_id") / 3).alias("doc_id"), F.col("conf").alias("score"), "engine")
    return op.federated([h.filter(F.col("engine") == e).drop("engine") for e in ("text", "semantic", "symbol")], 5)


@query(
    "authority_boost",
    WITH + """, b AS (SELECT query_id, doc_id, conf * CASE engine WHEN 'text' THEN 1.5::DOUBLE WHEN 'symbol' THEN 0.5::DOUBLE ELSE 1 END AS score FROM h)
    SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM b QUALIFY rank <= 5""",
)
def authority_boost(spark, sf_dir):
    h = hits(spark, sf_dir).select("query_id", "doc_id", F.col("conf").alias("score"), F.col("engine").alias("pillar"))
    return op.authority(h, {"text": 1.5, "symbol": 0.5}, 5).withColumn("score", F.round("score", 6))


SPAN_SQL = r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), 1) - 1 AS pos FROM documents),
    h AS (SELECT * FROM t WHERE term IN ('license', 'version', 'under')),
    n AS (SELECT doc_id FROM h GROUP BY 1 HAVING count(DISTINCT term) >= 2),
    k AS (SELECT doc_id, count(DISTINCT term) AS k FROM h GROUP BY 1),
    l AS (SELECT h.doc_id, h.pos, u.term, max(u.pos) AS last FROM h JOIN n USING (doc_id) JOIN h u ON u.doc_id = h.doc_id AND u.pos <= h.pos GROUP BY 1, 2, 3),
    s AS (SELECT doc_id, pos - min(last) + 1 AS span, count(*) AS c FROM l GROUP BY doc_id, pos)
    SELECT doc_id, min(span)::INTEGER AS span, round(pow(2.0::DOUBLE * any_value(k), 1.5) / (ln(greatest(min(span), 1)) + 1), 6) AS density FROM s JOIN k USING (doc_id) WHERE c = k GROUP BY doc_id"""


@query("span_density", SPAN_SQL)
def span_density(spark, sf_dir):
    from ..functions import text as T

    words = table(spark, sf_dir, "documents").select(F.lit(0).alias("query_id"), "doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "term"))
    found = op.span_density(words.filter(F.col("term").isin("license", "version", "under")).withColumn("idf", F.lit(2.0)))
    return found.select("doc_id", "span", F.round("density", 6).alias("density"))


@query("span_density_indexed", SPAN_SQL)
def span_density_indexed(spark, sf_dir):
    """:func:`span_density` from the positions of the stored index; no text is read."""
    found = op.span_density(text_index(spark, sf_dir).positions(["license", "version", "under"]).select(F.lit(0).alias("query_id"), "doc_id", "pos", "term", F.lit(2.0).alias("idf")))
    return found.select("doc_id", "span", F.round("density", 6).alias("density"))


@query("recall_fused")
def recall_fused(spark, sf_dir):
    found = recall.recall_fused(table(spark, sf_dir, "documents"), "Apache License, Version of the License", index=text_index(spark, sf_dir))
    return found.withColumn("score", F.round("score", 6))


@query("search_full")
def search_full(spark, sf_dir):
    found = recall.search_full(table(spark, sf_dir, "documents"), "which documents are licensed under the Apache license version and where is the text of the whole license said to be found in them", index=text_index(spark, sf_dir))
    return found.withColumn("score", F.round("score", 6))


@query("ask")
def ask(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    links = docs.select("doc_id", F.explode(F.array("lang", "source")).alias("concept"))
    symbols = docs.select(F.concat(F.lit("symbol"), F.col("doc_id").cast("string")).alias("name"), "doc_id")
    return recall.ask(docs, "Where is symbol100 licensed under the Apache license?", links, symbols, index=text_index(spark, sf_dir)).withColumn("conf", F.round("conf", 6))


SHAPES_SQL = """f AS (SELECT doc_id // 9 AS query_id, doc_id, (n_chars % 10) / 10.0::DOUBLE * (0.3::DOUBLE + 0.4::DOUBLE * greatest(doc_id % 7, n_chars % 7) / 7.0::DOUBLE + 0.3::DOUBLE * (doc_id % 2)) AS raw FROM documents)"""


@query("blueprint_recall", "WITH " + SHAPES_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, doc_id)::INTEGER AS rank FROM f WHERE round(raw, 9) >= 0.3)
    SELECT query_id, doc_id, rank, round(raw, 6) AS score FROM r WHERE rank <= 3""")
def blueprint_recall(spark, sf_dir):
    n, d = F.col("n_chars"), F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(F.floor(d / 9).alias("query_id"), "doc_id", (n % 10 / 10.0).alias("rel"), (d % 7 / 7.0).alias("cos"), (n % 7 / 7.0).alias("fp"), (d % 2 * 1.0).alias("intent"))
    return op.blueprint_score(rows, 3, 0.3).withColumn("score", F.round("score", 6))


@query("blueprint_learn", """WITH s AS (SELECT p_partkey, 'blueprint:' || lower(p_type) || '-' || p_size || CASE WHEN p_brand < 'Brand#2' THEN ':' || lower(p_brand) ELSE '' END AS doc_id, p_name FROM part),
    n AS (SELECT doc_id, arg_min(p_name, p_partkey) AS content FROM s GROUP BY doc_id), h AS (SELECT DISTINCT doc_id FROM s WHERE p_partkey % 5 = 0) SELECT doc_id, content FROM n WHERE doc_id NOT IN (SELECT doc_id FROM h)""")
def blueprint_learn(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    shapes = part.select(F.col("p_partkey").alias("seq"), F.concat_ws("-", "p_type", "p_size").alias("shape"), F.when(F.col("p_brand") < "Brand#2", F.col("p_brand")).alias("lang"), F.col("p_name").alias("content"))
    have = op.blueprints(shapes.filter("seq % 5 = 0"))
    return op.learned(have, op.blueprints(shapes)).select("doc_id", "content")


BATCH_SQL = r"""WITH t AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, count(DISTINCT term) AS length FROM t GROUP BY 1), n AS (SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT sum(length) FROM s) / (SELECT count(*) FROM documents) AS mean),
    q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark) GROUP BY ALL),
    p AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
    b AS (SELECT query_id, p.doc_id, sum(times * (ln((n_docs + 1) / (df + 1)) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score
      FROM q JOIN f USING (term) JOIN p USING (term) JOIN s ON s.doc_id = p.doc_id CROSS JOIN n JOIN documents d ON d.doc_id = p.doc_id WHERE d.lang <> 'de' GROUP BY 1, 2),
    w AS (SELECT query_id, doc_id, round(score * CASE WHEN doc_id % 3 = 0 THEN 1.25::DOUBLE ELSE 1 END, 6) AS score FROM b)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM w QUALIFY rank <= 10"""


@query("recall_batch", BATCH_SQL)
def recall_batch(spark, sf_dir):
    """All passages of ``benchmark`` as questions, one language left out, a third of the documents
    with a learned weight."""
    docs = table(spark, sf_dir, "documents")
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    learned = docs.filter("doc_id % 3 = 0").select("doc_id", F.lit(1.25).alias("weight"))
    best, _ = recall.recall_batch(text_index(spark, sf_dir), questions, docs.filter("lang <> 'de'"), learned, digits=6)
    return best
