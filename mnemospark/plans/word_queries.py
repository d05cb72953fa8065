r"""Functions of words, lines and questions over whole tables.

Where the tables' texts lack what a function looks for (tags, links, code), it is written into
them from their other columns, so the rows grow with the tables.  Java's ``\d`` and ``\b`` and
DuckDB's know the same ASCII; what needs a back reference is said with lists in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stem import stems, word_pieces
from ..operators import state
from ..operators import text as op
from .registry import query
from .state_queries import SALIENCE_SQL
from .tables import FRAMES_SQL, TOKENS_SQL, frames, table


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text is not null")


def talk(spark, sf_dir):
    return table(spark, sf_dir, "conversations").filter("text is not null")


def terms(spark, sf_dir):
    return docs(spark, sf_dir).select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word")).distinct()


TERMS_SQL = "WITH " + TOKENS_SQL + ", t AS (SELECT DISTINCT term AS word FROM tokens)"
TALK_SQL = "WITH c AS (SELECT * FROM conversations WHERE text IS NOT NULL)"
PARTS_SQL = r"list_filter(string_split_regex(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda w: w <> '')"


def sounds_sql(word: str) -> str:
    letters = f"regexp_replace(upper(replace({word}, 'ß', 'ss')), '[^A-Z]', '', 'g')"  # as Java has it
    code = f"string_split(translate({letters}, 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000000'), '')"
    once = f"list_filter({code}, lambda x, i: i = 1 OR x <> {code}[i - 1])"
    return f"CASE WHEN {letters} = '' THEN '0000' ELSE left(rpad(left({letters}, 1) || replace(array_to_string({once}[2:], ''), '0', ''), 4, '0'), 4) END"


@query("split_identifier", r"WITH n AS (SELECT p_partkey, replace(p_name, ' ', '_') || 'HTTPServer' || upper(left(p_type, 1)) || lower(substr(p_type, 2)) || 'ID' || p_size AS name FROM part) SELECT p_partkey, array_to_string(" + PARTS_SQL + ", ' ') AS parts FROM n")
def split_identifier(spark, sf_dir):
    kind = F.concat(F.upper(F.substring("p_type", 1, 1)), F.lower(F.substring("p_type", 2, 99)))
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("HTTPServer"), kind, F.lit("ID"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", T.split_identifier(name)).alias("parts"))


@query("soundex_ref", TERMS_SQL + " SELECT word, " + sounds_sql("word") + " AS code FROM t")
def soundex_ref(spark, sf_dir):
    return terms(spark, sf_dir).select("word", T.sounds(F.col("word")).alias("code"))


@query(
    "fuzzy_expand",
    "WITH v AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part), w AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN word ELSE left(word, 1) || substr(word, 3) END AS word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)),"
    + " p AS (SELECT w.word, v.word AS match, levenshtein(w.word, v.word)::INTEGER AS distance FROM (SELECT word, " + sounds_sql("word") + " AS code FROM w) w JOIN (SELECT word, " + sounds_sql("word") + " AS code FROM v) v USING (code)),"
    + " k AS (SELECT *, max((distance = 0)::INTEGER) OVER (PARTITION BY word) AS exact FROM p WHERE distance <= 2) SELECT word, match, distance, row_number() OVER (PARTITION BY word ORDER BY distance, match)::INTEGER AS rank FROM k WHERE exact = 0 OR distance = 0 QUALIFY rank <= 5",
)
def fuzzy_expand(spark, sf_dir):
    words = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    typed = F.when(F.col("p_partkey") % 3 == 0, F.col("word")).otherwise(F.concat(F.substring("word", 1, 1), F.substring("word", 3, 99)))
    return op.fuzzy(words.select(typed.alias("word")).distinct(), words.select("word").distinct())


@query(
    "morph_variants",
    r"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) AS word FROM documents),
    f AS (SELECT word, list_concat(list_filter([word, CASE WHEN word LIKE '%ers' AND length(word) >= 6 THEN left(word, length(word) - 3) END, CASE WHEN word LIKE '%ing' AND length(word) >= 6 THEN left(word, length(word) - 3) END,
      CASE WHEN word LIKE '%ed' AND length(word) >= 5 THEN left(word, length(word) - 2) END, CASE WHEN word LIKE '%es' AND length(word) >= 5 THEN left(word, length(word) - 2) END, CASE WHEN word LIKE '%s' AND length(word) >= 4 THEN left(word, length(word) - 1) END],
      lambda x: x IS NOT NULL), list_filter(string_split(word, '-'), lambda x: length(x) >= 3)) AS forms FROM t)
    SELECT word, array_to_string(list_sort(list_distinct(forms)), ' ') AS forms FROM f""",
)
def morph_variants(spark, sf_dir):
    words = docs(spark, sf_dir).select(F.explode(F.array_distinct(T.words(F.lower("text")))).alias("word")).distinct()
    return words.select("word", F.concat_ws(" ", F.array_sort(T.variants(F.col("word")))).alias("forms"))


@query("compound_split", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'pass key' WHEN 1 THEN 'pass word' WHEN 2 THEN 'pass code' ELSE p_brand END AS parts FROM part")
def compound_split(spark, sf_dir):
    kind = F.col("p_partkey") % 4
    word = F.when(kind == 0, "passkey").when(kind == 1, "password").when(kind == 2, "passcode").otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", T.compounds(word)).alias("parts"))


@query("keywords", TALK_SQL + r" SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in T.QUESTION_STOPWORDS) + r") AND (length(w) >= 3 OR regexp_matches(w, '\d'))))), ' ') AS words FROM c")
def keywords(spark, sf_dir):
    return talk(spark, sf_dir).select("conv_id", "turn", F.concat_ws(" ", F.array_sort(T.keywords(F.col("text")))).alias("words"))


@query("detect_scope_tag", TALK_SQL + " SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN 'version:' || conv_id WHEN 1 THEN 'dept:' || turn WHEN 2 THEN 'version:' || conv_id WHEN 3 THEN 'status:confidential' END AS tag FROM c")
def detect_scope_tag(spark, sf_dir):
    kind, number = F.col("conv_id") % 5, F.col("conv_id").cast("string")
    asked = F.when(kind == 0, F.concat(F.lit("open version "), number, F.lit(": "))).when(kind == 1, F.concat(F.lit("Dept. "), F.col("turn").cast("string"), F.lit(" on "))).when(kind == 2, F.concat(F.lit("REV "), number, F.lit(", final "))).when(kind == 3, "the confidential, ").otherwise("")
    return talk(spark, sf_dir).select("conv_id", "turn", T.scope_tag(F.concat(asked, F.col("text"))).alias("tag"))


@query("wikilinks", "WITH d AS (SELECT doc_id, unnest(list_distinct([lower(source), lower(lang || ' text')])) AS concept FROM documents WHERE text IS NOT NULL) SELECT doc_id, concept FROM d WHERE concept IS NOT NULL")
def wikilinks(spark, sf_dir):
    linked = F.concat("text", F.lit(" [["), F.initcap("source"), F.lit("|x]] [[ "), F.initcap("lang"), F.lit(" text #y]] m[[i]] [[12]] [["), "source", F.lit("]]"))
    return docs(spark, sf_dir).select("doc_id", F.explode(T.wikilinks(linked)).alias("concept"))


@query("action_residue", TALK_SQL + r" SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all(lower('Fix src/main.rs and v2 in ' || text), '[^\x20\x09-\x0D]+'), lambda w: NOT regexp_matches(w, '[./\\_:]|\d')), ' ') AS residue FROM c")
def action_residue(spark, sf_dir):
    return talk(spark, sf_dir).select("conv_id", "turn", T.action_residue(F.concat(F.lit("Fix src/main.rs and v2 in "), "text")).alias("residue"))


@query("search_kv", "SELECT doc_id, doc_id::VARCHAR AS value FROM documents WHERE text IS NOT NULL")
def search_kv(spark, sf_dir):
    told = F.concat(F.lit("The Passkey is the "), F.col("doc_id").cast("string"), F.lit("; "), "text")
    return docs(spark, sf_dir).select("doc_id", F.trim(T.value_of_key(told, "passkey")).alias("value"))


@query(
    "auto_tags",
    r"""WITH d AS (SELECT doc_id, 'plan_v' || doc_id || CASE doc_id % 3 WHEN 0 THEN '_draft' WHEN 1 THEN '_Final' ELSE '' END || '.docx' AS name, 'Revision ' || n_chars || CASE WHEN doc_id % 2 = 0 THEN ' CONFIDENTIAL ' ELSE ' ' END || text AS text, n_chars FROM documents WHERE text IS NOT NULL),
    t AS (SELECT doc_id, unnest(list_distinct(['version:' || doc_id, 'version:' || n_chars, CASE WHEN contains(lower(name), 'draft') OR regexp_matches(text, '(?i)\bdraft\b') THEN 'status:draft' WHEN contains(lower(name), 'final') THEN 'status:final' END, CASE WHEN contains(text, 'CONFIDENTIAL') THEN 'status:confidential' END])) AS tag FROM d)
    SELECT doc_id, tag FROM t WHERE tag IS NOT NULL""",
)
def auto_tags(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 3 == 0, "_draft").when(F.col("doc_id") % 3 == 1, "_Final").otherwise("")
    name = F.concat(F.lit("plan_v"), F.col("doc_id").cast("string"), kind, F.lit(".docx"))
    text = F.concat(F.lit("Revision "), F.col("n_chars").cast("string"), F.when(F.col("doc_id") % 2 == 0, " CONFIDENTIAL ").otherwise(" "), "text")
    return docs(spark, sf_dir).select("doc_id", F.explode(T.auto_tags(name, text)).alias("tag"))


@query(
    "ground_dates",
    TALK_SQL + """, d AS (SELECT conv_id, turn, DATE '2024-01-15' + (conv_id % 700)::INTEGER AS day FROM c)
    SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN ' [last year = ' || (year(day) - 1) || ']' WHEN 1 THEN ' [last quarter = Q' || quarter(day - INTERVAL 3 MONTH) || ' ' || year(day - INTERVAL 3 MONTH) || ']' ELSE ' [last month = ' || strftime(day - INTERVAL 1 MONTH, '%Y-%m') || ']' END AS note FROM d""",
)
def ground_dates(spark, sf_dir):
    day = F.date_add(F.lit("2024-01-15").cast("date"), (F.col("conv_id") % 700).cast("int"))
    text = F.concat("text", F.when(F.col("turn") % 3 == 0, " Last year").when(F.col("turn") % 3 == 1, " last QUARTER").otherwise(" last month"))
    grounded = T.ground_dates(text, day)
    return talk(spark, sf_dir).select("conv_id", "turn", F.substring(grounded, F.length(text) + 1, F.lit(99)).alias("note"))


@query(
    "clean_text",
    TALK_SQL + r""", l AS (SELECT conv_id, turn, string_split(CASE turn % 3 WHEN 0 THEN '-- ** !! ' || repeat('=', 2000) ELSE replace(text, 'a', 'aaaa') END, '') AS x FROM c),
    r AS (SELECT conv_id, turn, trim(regexp_replace(array_to_string(list_filter(x, lambda v, i: i <= 2 OR v = chr(10) OR v <> x[i - 1] OR v <> x[i - 2]), ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS t FROM l)
    SELECT conv_id, turn, md5(CASE WHEN strlen(t) < 2 OR length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) * 2 < length(t) THEN '' ELSE t END) AS h FROM r""",
)
def clean_text(spark, sf_dir):
    noisy = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("-- ** !! "), F.repeat(F.lit("="), F.lit(2000)))).otherwise(F.replace("text", F.lit("a"), F.lit("aaaa")))
    return talk(spark, sf_dir).select("conv_id", "turn", F.md5(T.clean_ocr(noisy)).alias("h"))


@query("extract_calls", "SELECT conv_id, turn, unnest(['f' || conv_id, 'bar' || turn, 'usp_' || role]) AS call FROM conversations")
def extract_calls(spark, sf_dir):
    code = F.concat(F.lit("if (f"), F.col("conv_id").cast("string"), F.lit("(bar"), F.col("turn").cast("string"), F.lit(" (1))) return f"), F.col("conv_id").cast("string"), F.lit("(0); EXEC dbo.usp_"), "role", F.lit(" @x=1"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(T.calls(code)).alias("call"))


@query(
    "cjk_bigrams",
    TALK_SQL + r""", r AS (SELECT unnest(regexp_extract_all(translate(text, 'aeinrst', '日本語中文かカ'), '[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]{2,}')) AS run FROM c),
    g AS (SELECT substr(run, k::BIGINT, 2) AS gram FROM (SELECT run, unnest(range(1, length(run))) AS k FROM r)) SELECT gram, count(*) AS n FROM g GROUP BY gram""",
)
def cjk_bigrams(spark, sf_dir):
    text = F.translate("text", "aeinrst", "日本語中文かカ")
    return talk(spark, sf_dir).select(F.explode(T.cjk_bigrams(text)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query(
    "stitch_pages",
    TALK_SQL + r""", p AS (SELECT conv_id AS source, turn AS page, CASE WHEN turn % 2 = 0 THEN left(text, greatest(length(text) - 3, 1)) ELSE lower(text) END AS text FROM c),
    b AS (SELECT *, lag(rtrim(text, ' ')) OVER (PARTITION BY source ORDER BY page) AS before FROM p)
    SELECT source, page, md5(CASE WHEN NOT regexp_matches(before, '[.!?:;…]\n?$') AND regexp_matches(ltrim(text, ' '), '^[\p{Ll}\d]') THEN trim(regexp_extract(before, '([^.!?]*)$', 1), ' ') || ' ' || text ELSE text END) AS h FROM b""",
)
def stitch_pages(spark, sf_dir):
    cut = F.when(F.col("turn") % 2 == 0, F.substring("text", F.lit(1), F.greatest(F.length("text") - 3, F.lit(1)))).otherwise(F.lower("text"))
    pages = talk(spark, sf_dir).select(F.col("conv_id").alias("source"), F.col("turn").alias("page"), cut.alias("text"))
    return op.stitch_pages(pages).select("source", "page", F.md5("text").alias("h"))


@query(
    "ngram_tiebreak",
    r"""WITH h AS (SELECT doc_id, round(n_chars / 1000.0::DOUBLE, 3) AS score, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') || ' ' AS body FROM documents WHERE text IS NOT NULL),
    q AS (SELECT string_split('licensed under the apache license', ' ') AS w), n AS (SELECT unnest([2, 3, 4, 5]) AS n),
    g AS (SELECT DISTINCT n, array_to_string(w[k::BIGINT:k::BIGINT + n - 1], ' ') AS gram FROM (SELECT n, w, unnest(range(1, 7 - n)) AS k FROM q, n)),
    c AS (SELECT doc_id, score, n, gram, (length(body) - length(replace(body, ' ' || gram || ' ', ' '))) / (length(gram) + 1)::DOUBLE AS times FROM h CROSS JOIN g),
    b AS (SELECT *, CASE WHEN count(*) FILTER (WHERE times > 0) OVER (PARTITION BY gram) = 1 AND times > 0 THEN 0.05::DOUBLE * n * n * times ELSE 0 END AS bonus FROM c)
    SELECT doc_id, round(score + sum(bonus), 6) AS score FROM b GROUP BY doc_id, score""",
)
def ngram_tiebreak(spark, sf_dir):
    hits = docs(spark, sf_dir).select("doc_id", F.round(F.col("n_chars") / 1000.0, 3).alias("score"), "text")
    return op.ngram_tiebreak(hits, "licensed under the apache license").withColumn("score", F.round("score", 6))


@query("stem_tokens")
def stem_tokens(spark, sf_dir):
    """SQL has no stemmer; typed words and their stems are in the tests."""
    return terms(spark, sf_dir).select("word", F.element_at(stems(F.array("word")), 1).alias("stem"))


@query("word_pieces", "SELECT p_partkey, lower(left(p_type, 1)) || regexp_replace(lower(substr(p_type, 2)), '(.)', ' ##\\1', 'g') || ' # ' || '[UNK]' AS pieces FROM part")
def word_pieces_of_parts(spark, sf_dir):
    letters = "abcdefghijklmnopqrstuvwxyz"
    tokenize = word_pieces({*letters, *(f"##{x}" for x in letters), "#"})
    text = F.concat("p_type", F.lit(" # "), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", tokenize(text)).alias("pieces"))


SAID_SQL = FRAMES_SQL + """, said AS (SELECT * REPLACE (CASE conv_id % 4 WHEN 0 THEN 'Important: ' WHEN 1 THEN 'We decided: ' WHEN 2 THEN 'Actually, ' ELSE '' END || content AS content) FROM frames),""" + SALIENCE_SQL.replace("FROM frames)", "FROM said)")


def _any(markers) -> str:
    return "(" + " OR ".join("contains(lower(content), '" + m.replace("'", "''") + "')" for m in markers) + ")"


@query(
    "salience_golden",
    "WITH " + SAID_SQL + f"""SELECT frame_id, score, 'salience:' || CASE WHEN score < 30 THEN 'low' WHEN score < 60 THEN 'medium' ELSE 'high' END || CASE WHEN {_any(state.CORRECTION)} THEN ',reconsolidation' ELSE '' END
    || CASE WHEN {_any(state.DECISION)} THEN ',decision' ELSE '' END || CASE WHEN {_any(state.EXPLICIT)} THEN ',explicit' ELSE '' END AS tags FROM sal JOIN said USING (frame_id)""",
)
def salience_golden(spark, sf_dir):
    kind = F.col("conv_id") % 4
    said = frames(spark, sf_dir).withColumn("content", F.concat(F.when(kind == 0, "Important: ").when(kind == 1, "We decided: ").when(kind == 2, "Actually, ").otherwise(""), "content"))
    return state.salience_tags(said, "content").select("frame_id", "score", F.concat_ws(",", "salience_tags").alias("tags"))


@query("surprise", "SELECT doc_id, CASE WHEN n_chars % 100 < 25 THEN 'benign' WHEN doc_id % 101 >= 90 THEN 'update' WHEN doc_id % 101 >= 40 THEN 'contradiction' ELSE 'benign' END AS surprise FROM documents")
def surprise(spark, sf_dir):
    pairs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 100 / 100.0).alias("similarity"), (F.col("doc_id") % 101 / 100.0).alias("overlap"))
    return state.surprise(pairs).select("doc_id", "surprise")


@query("dream_clusters", "WITH m AS (SELECT min(s_suppkey) OVER (PARTITION BY s_nationkey) AS leader, s_suppkey AS member, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) SELECT leader, member FROM m WHERE k <= 8 AND n > 1")
def dream_clusters(spark, sf_dir):
    """Suppliers near the first of their nation."""
    s = table(spark, sf_dir, "supplier")
    first = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("a"))
    return state.greedy_groups(s.join(first, "s_nationkey").select("a", F.col("s_suppkey").alias("b")), "a", "b")
