"""Relational text operators: postings, statistics, lexical scores, search by substring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .index import TextIndex


def term_freq(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``term``, ``tf``."""
    return docs.select(key, F.explode(T.tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def word_idf(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word``, ``df``, ``idf = ln((N + 1) / (df + 1)) + 1`` over all documents."""
    n = docs.agg(F.count("*").alias("n"))
    df = docs.select(F.explode(F.array_distinct(T.trimmed_words(F.col(text)))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("word", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))  # n: one row


def lexical_stats(docs: DataFrame | TextIndex, terms: Sequence[str]) -> DataFrame:
    """Postings of the given terms with everything a lexical score needs: ``doc_id``, ``term``,
    ``tf``, ``df``, ``length`` (distinct terms of the document), ``n_docs``, ``mean_length``.

    From an index only the postings of the terms are read.  From texts, tokens are filtered before
    they are counted, so only the query's terms are shuffled; a null text is empty.
    """
    if isinstance(docs, TextIndex):
        return docs.stats(terms)
    found = docs.select("doc_id", T.tokens(F.coalesce("text", F.lit(""))).alias("all"))
    sized = found.select("doc_id", "all", F.size(F.array_distinct("all")).cast("long").alias("length"))
    totals = sized.agg(F.count("*").alias("n_docs"), F.greatest(F.avg("length"), F.lit(1.0)).alias("mean_length"))
    each = sized.select("doc_id", "length", F.explode("all").alias("term")).filter(F.col("term").isin(*dict.fromkeys(terms)))
    hits = each.groupBy("doc_id", "length", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    return hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(totals))  # df: a row per term asked; totals: one row


def _terms(docs: DataFrame | TextIndex, query: str) -> list[str]:
    """Words of a query as the terms of what is searched: stemmed where its index is."""
    words = query.lower().split()
    return docs.query_terms(words) if isinstance(docs, TextIndex) else words


def bm25(docs: DataFrame | TextIndex, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``doc_id``, ``score`` of all documents that hold a term of the query; a word that the
    query repeats counts as often."""
    terms = _terms(docs, query)
    times = F.create_map(*[F.lit(x) for t in dict.fromkeys(terms) for x in (t, float(terms.count(t)))])
    s = lexical_stats(docs, terms)
    idf = F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1
    norm = F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length"))
    return s.withColumn("part", times[F.col("term")] * idf * F.col("tf") * (k1 + 1) / norm).groupBy("doc_id").agg(F.sum("part").alias("score"))


def lexical_share(docs: DataFrame | TextIndex, query: str) -> DataFrame:
    """Share of the query's idf that a document matches, over all documents with a match."""
    s = lexical_stats(docs, _terms(docs, query))
    idf = F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1
    known = s.select("term", idf.alias("idf")).distinct().agg(F.greatest(F.sum("idf"), F.lit(1.0)).alias("all_idf"))
    return s.withColumn("idf", idf).groupBy("doc_id").agg(F.sum("idf").alias("matched")).crossJoin(F.broadcast(known)).select("doc_id", (F.col("matched") / F.col("all_idf")).alias("score"))


def top(rows: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first ``k`` rows; callers end ``order`` with a key, so ties are settled."""
    return rows.orderBy(*order).limit(k)


def top_per(rows: DataFrame, key: str, k: int, *order: Column | str) -> DataFrame:
    """The first ``k`` rows of each key, with ``rank`` from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)


def grep(docs: DataFrame, pattern: str) -> DataFrame:
    """``doc_id``, ``n`` of documents that hold the literal, by case-insensitive count."""
    low = F.lower("text")
    return docs.filter(low.contains(pattern.lower())).select("doc_id", T.count_of(F.col("text"), pattern).alias("n"))


def grep_lines(docs: DataFrame, pattern: str) -> DataFrame:
    """``doc_id``, ``line_no`` from 1, ``line`` for every line that matches an expression."""
    lines = docs.filter(F.col("text").rlike(pattern)).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.filter(F.col("line").rlike(pattern)).withColumn("line_no", F.col("line_no") + 1)


def trigram_postings(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(T.trigrams(F.col("text"))).alias("tri"), "doc_id")


def trigram_candidates(docs: DataFrame, pattern: str, index: TextIndex | None = None) -> DataFrame:
    """``doc_id`` of documents that hold every trigram of a pattern; a pattern of fewer than
    three characters is looked for itself, in all documents.

    With an index the posting lists answer; without one a pass over the texts does.
    """
    if index is not None and len(pattern) >= 3:
        return index.trigram_candidates(pattern)
    low = pattern.lower()
    wanted = sorted({low[k : k + 3] for k in range(len(low) - 2)}) or [low]
    found = F.lit(True)
    for part in wanted:
        found = found & F.lower("text").contains(part)
    return docs.filter(found).select("doc_id")


def holding_all(docs: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Documents whose postings hold all terms: the intersection of posting lists."""
    distinct = docs.select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("all"))
    return distinct.filter(F.size(F.array_intersect("all", F.array(*map(F.lit, terms)))) == len(set(terms))).select("doc_id")


def holding_any(docs: DataFrame, terms: Sequence[str]) -> DataFrame:
    return docs.filter(F.arrays_overlap(T.tokens(F.col("text")), F.array(*map(F.lit, terms)))).select("doc_id")


def dedup_exact(docs: DataFrame) -> DataFrame:
    """First document of each text, by hash of the text."""
    return docs.groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


def content_dedup(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """Of hits with equal content, the one of highest confidence, then smallest id."""
    best = Window.partitionBy(key, "sig").orderBy(F.col("conf").desc(), "doc_id")
    return hits.withColumn("sig", F.xxhash64(T.content_key(F.col("text")))).withColumn("__rank", F.row_number().over(best)).filter("__rank = 1").drop("__rank", "sig")


def fuzzy(words: DataFrame, vocabulary: DataFrame, distance: int = 2, nearest: int = 5) -> DataFrame:
    """Words with the vocabulary words that sound alike and are at most ``distance`` edits
    away, nearest first; a word of the vocabulary has itself only."""
    coded = words.select("word", T.sounds(F.col("word")).alias("code"))
    known = vocabulary.select(F.col("word").alias("match"), T.sounds(F.col("word")).alias("code"))
    pairs = coded.join(known, "code").withColumn("distance", F.levenshtein("word", "match")).filter(F.col("distance") <= distance)
    exact = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("word")) == 1
    kept = pairs.withColumn("exact", exact).filter(~F.col("exact") | (F.col("distance") == 0))
    return top_per(kept, "word", nearest, "distance", "match").select("word", "match", "distance", "rank")


def phrase_boost(docs: DataFrame, query: str) -> DataFrame:
    """Factor for documents with a run of the query's words: 1.25 for four, 1.15 for three."""
    parts = query.lower().split()
    runs = lambda n: [" ".join(parts[k : k + n]) for k in range(len(parts) - n + 1)]
    low = F.concat_ws(" ", T.tokens(F.col("text")))
    holds = lambda n: F.array_contains(F.transform(F.array(*map(F.lit, runs(n))), lambda r: F.contains(low, r)), True) if runs(n) else F.lit(False)
    return docs.select("doc_id", F.when(holds(4), 1.25).when(holds(3), 1.15).otherwise(1.0).alias("boost"))


def ngram_tiebreak(hits: DataFrame, query: str, low: int = 2, high: int = 6) -> DataFrame:
    """Scores of a short list of hits plus ``0.05 * n**2`` per occurrence of each of the query's
    n-grams that is in one of the hits only."""
    grams = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(g).alias("gram")) for n in range(low, high + 1) for g in dict.fromkeys(" ".join(query.lower().split()[k : k + n]) for k in range(len(query.split()) - n + 1))])
    text = F.concat(F.lit(" "), F.concat_ws(" ", T.tokens(F.col("text"))), F.lit(" "))
    counted = hits.select("doc_id", "score", F.explode(grams).alias("g"), text.alias("body")).select("doc_id", "score", "g.n", "g.gram", ((F.length("body") - F.length(F.replace("body", F.concat(F.lit(" "), F.col("g.gram"), F.lit(" ")), F.lit(" ")))) / (F.length("g.gram") + 1)).alias("times"))
    held = F.count_if(F.col("times") > 0).over(Window.partitionBy("gram"))
    bonus = F.when((held == 1) & (F.col("times") > 0), 0.05 * F.col("n") * F.col("n") * F.col("times")).otherwise(0.0)
    return counted.withColumn("bonus", bonus).groupBy("doc_id", "score").agg(F.sum("bonus").alias("bonus")).select("doc_id", (F.col("score") + F.col("bonus")).alias("score"))


def repeated_page_lines(pages: DataFrame, share: float = 0.6, most_words: int = 4, most_bytes: int = 40) -> DataFrame:
    """``source``, ``line``: short lines on at least ``share`` of a source's pages."""
    lines = pages.select("source", "page", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.trim(x)))).alias("line"))
    short = lines.filter((F.octet_length("line").between(1, most_bytes)) & (F.size(F.split("line", " +")) <= most_words))
    counts = short.groupBy("source", "line").agg(F.count("*").alias("n"))
    total = pages.groupBy("source").agg(F.count("*").alias("pages"))
    return counts.join(total, "source").filter((F.col("pages") >= 3) & (F.col("n") >= F.floor(F.col("pages") * share))).select("source", "line")


def strip_lines(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Pages without the lines listed for their source, in order."""
    listed = lines.groupBy("source").agg(F.collect_set("line").alias("drop"))
    kept = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.coalesce("drop", F.array().cast("array<string>")), F.trim(x)))
    return pages.join(listed, "source", "left").withColumn("text", F.concat_ws("\n", kept)).drop("drop")


def strip_headers(pages: DataFrame, share: float = 0.6) -> DataFrame:
    """Pages without a first line of under 80 bytes that at least ``share`` of a source's
    non-empty pages begin with; sources of fewer than three pages stay as they are."""
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    filled = pages.filter(F.length(F.trim("text")) > 0).withColumn("first", first)
    total = filled.groupBy("source").agg(F.count("*").alias("pages"))
    heads = filled.filter(F.octet_length("first") < 80).groupBy("source", "first").agg(F.count("*").alias("n")).join(total, "source")
    heads = heads.filter((F.col("pages") >= 3) & (F.col("n") >= F.greatest(F.lit(1), F.floor(F.col("pages") * share)))).select("source", F.col("first").alias("head")).filter("head <> ''")
    cut = pages.withColumn("head", first).join(heads.withColumn("is_head", F.lit(True)), ["source", "head"], "left")
    return cut.withColumn("text", F.when(F.col("is_head"), F.ltrim(F.expr("substring(text, length(head) + 2)"))).otherwise(F.col("text"))).drop("head", "is_head")


def stitch_pages(pages: DataFrame) -> DataFrame:
    """Where a page ends within a sentence and the next begins in lower case or a digit, the
    tail after the last full stop is put before the next page."""
    w = Window.partitionBy("source").orderBy("page")
    before = F.lag(F.rtrim("text")).over(w)
    open_end = ~before.rlike(r"[.!?:;…]$") & F.ltrim("text").rlike(r"^[\p{Ll}\d]")
    tail = F.regexp_extract(before, r"([^.!?]*)$", 1)
    return pages.withColumn("text", F.when(F.coalesce(open_end, F.lit(False)), F.concat(F.trim(tail), F.lit(" "), F.col("text"))).otherwise(F.col("text")))
