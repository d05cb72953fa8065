"""Composite retrieval: the fused recall of short questions and the many-engine ask."""

from __future__ import annotations

import re
import string
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stem import stems
from ..scratch import written
from . import retrieval as R
from . import text as X
from .graph import concept_bridge
from .index import TextIndex
from .state import weighted


def phrases(query: str) -> list[str]:
    """Phrases of a question: runs of capitalised words, parts between commas, what follows the
    last "of"; the whole question if there are none."""
    found = re.findall(r"[A-Z]\w+(?: [A-Z]\w+)+", query)
    found += [x.strip() for x in query.split(",")] if "," in query else []
    found += [query.rsplit(" of ", 1)[1]] if " of " in query else []
    clean = [x.strip(" ?.!").lower() for x in found]
    return list(dict.fromkeys(x for x in clean if len(x) >= 3)) or [query.strip(" ?.!").lower()]


def _phrase_hits(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """``doc_id``, ``phrase`` and how often the document's text holds it, for all phrases in one
    pass over the texts."""
    low = docs.select("doc_id", F.lower("text").alias("text"))
    some = low.filter(reduce(or_, [F.col("text").contains(p.lower()) for p in wanted]))
    counts = F.array(*[F.struct(F.lit(p).alias("phrase"), T.count_of(F.col("text"), p).alias("n")) for p in wanted])
    return some.select("doc_id", F.explode(F.filter(counts, lambda c: c["n"] > 0)).alias("c")).select("doc_id", "c.phrase", "c.n")


def recall_fused(docs: DataFrame, query: str, k: int = 10, index: TextIndex | None = None) -> DataFrame:
    """Lexical top 50, raised by documents that hold a rare phrase of the question, ties among
    the best settled by shared word runs.

    A phrase counts if at most ten documents hold it: fully up to five, then by ``5 / n``.
    Returns ``doc_id``, ``score``, the best ``k``.  With an ``index`` of ``docs`` the lexical part
    reads postings; phrases are one pass over the texts either way.
    """
    base = X.top(X.bm25(index or docs, query), 50, F.col("score").desc(), "doc_id").withColumn("query_id", F.lit(0))
    found = _phrase_hits(docs, phrases(query))
    spread = found.groupBy("phrase").agg(F.count("*").alias("docs")).filter("docs <= 10")
    weight = F.col("n") * F.when(F.col("docs") <= 5, 1.0).otherwise(5.0 / F.col("docs"))
    specific = found.join(F.broadcast(spread), "phrase").groupBy("doc_id").agg(F.sum(weight).alias("mentions")).withColumn("query_id", F.lit(0))  # at most a row per phrase
    merged = R.inject(base, specific)
    best = X.top(merged, k, F.col("score").desc(), "doc_id").select("doc_id", "score")
    with_text = docs.select("doc_id", "text").join(F.broadcast(best), "doc_id")  # k rows
    return X.ngram_tiebreak(with_text, query)


def recall_batch(index: TextIndex, questions: DataFrame, scope: DataFrame | None = None, state: DataFrame | None = None, k: int = 10, k1: float = 1.2, b: float = 0.75, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The best documents of a table of questions (``query_id``, ``text``) in one plan: ``query_id``,
    ``rank``, ``doc_id``, ``score``; and the log to append, a row per question with its hits.

    BM25 over the stored postings; ``scope`` (``doc_id``) leaves documents out before the best are
    taken, while statistics stay those of the corpus; ``state`` (``doc_id``, ``weight``) multiplies
    scores by what recalls have taught, 1.0 where nothing; with ``digits`` scores are rounded before
    they are ranked, so those equal to so many places are ties, to the smaller ``doc_id``.  No text
    is read, and nothing written.
    A question without known words has no hits and a log row with none.
    """
    words = questions.select("query_id", F.explode(T.tokens(F.coalesce("text", F.lit("")))).alias("term"))
    asked = words.groupBy("query_id", "term").agg(F.count("*").alias("times"))
    if index.stemmed:
        asked = asked.withColumn("term", F.element_at(stems(F.array("term")), 1)).groupBy("query_id", "term").agg(F.sum("times").alias("times"))
    postings = written(index.postings_of(asked), "postings", per_core=4)
    df = written(postings.groupBy("term").agg(F.count("*").alias("df")), "frequencies", per_core=1)
    hits = postings if scope is None else postings.join(scope.select("doc_id").distinct(), "doc_id", "left_semi")
    n_docs, n_terms = index.totals
    mean = max(n_terms / n_docs, 1.0) if n_docs else 1.0
    idf = F.log((F.lit(n_docs) + 1) / (F.col("df") + 1)) + 1
    part = F.col("times") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean))
    scored = asked.join(df, "term").join(hits, "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))
    if state is not None:
        scored = weighted(scored, state)
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    ranked = scored.withColumn("rank", F.row_number().over(R.Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")))
    best = written(ranked.filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score"), "best", per_core=1)
    kept = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id")))["doc_id"].alias("hits"))  # k a question
    log = questions.join(kept, "query_id", "left").select("query_id", "text", F.coalesce("hits", F.array().cast(dict(kept.dtypes)["hits"])).alias("hits"))
    return best, log


def search_full(docs: DataFrame, query: str, k: int = 10, index: TextIndex | None = None) -> DataFrame:
    """Questions about codes by keyword, short ones by fused recall, long ones by passages.

    A long one (20 words or more) takes the 50 best documents and the 100 best windows of words, and
    raises documents by their windows; the first ten gain by word runs that only one of them holds;
    documents of the fused recall that are not there enter at 0.9 of the best score, those of the ten
    best passages at 0.7; then :func:`kept_ahead`."""
    parts = query.lower().split()
    bare = [w.rstrip(string.punctuation) for w in parts]
    if any(w in T.CODE_WORDS or re.fullmatch(r"\d{5,10}", w) for w in bare):
        scores = X.bm25(index or docs, query).withColumn("query_id", F.lit(0))
        counts = docs.select(F.lit(0).alias("query_id"), "doc_id", sum((T.count_of(F.col("text"), w) for w in bare if w in T.CODE_WORDS), F.lit(0)).alias("n")).filter("n > 0")
        return X.top(R.needle(scores, counts).select("doc_id", "score"), k, F.col("score").desc(), "doc_id")
    if len(parts) < 20:
        return recall_fused(docs, query, k, index)
    by_score = (F.col("score").desc(), "doc_id")
    whole = written(X.top(X.bm25(index or docs, query), 50, *by_score), "whole", small=True)
    passages = docs.select("doc_id", F.explode(T.word_windows(F.col("text"))).alias("w")).select(F.struct("doc_id", "w.pos").alias("doc_id"), F.col("w.part").alias("text"))
    best = X.top(X.bm25(passages, query), 100, *by_score).select(F.col("doc_id.doc_id").alias("doc_id"), "score")
    best = written(best, "passages", small=True)
    zero = F.lit(0).alias("query_id")
    blended = R.passage_blend(whole.select(zero, "doc_id", F.col("score").alias("own")), best.select(zero, "doc_id", "score")).select("doc_id", "score")
    first = X.top(blended, 10, *by_score)
    told = X.ngram_tiebreak(docs.select("doc_id", "text").join(F.broadcast(first), "doc_id"), query, 2, 5)  # 10 rows
    raised = blended.join(told.select("doc_id", F.col("score").alias("more")), "doc_id", "left").select("doc_id", F.coalesce("more", "score").alias("score"))
    ranked = written(raised, "ranked", small=True)
    for found, share in ((recall_fused(docs, query, 50, index), 0.9), (X.top(best.groupBy("doc_id").agg(F.max("score").alias("score")), 10, *by_score), 0.7)):
        new = found.select("doc_id").join(ranked, "doc_id", "left_anti")
        top = ranked.agg(F.max("score").alias("score"))
        ranked = written(ranked.union(new.crossJoin(F.broadcast(top.select(share * F.col("score")))).toDF("doc_id", "score")), "ranked", small=True)  # one row
    return kept_ahead(ranked.join(whole.select("doc_id", F.lit(True).alias("own")), "doc_id", "left"), k)


def kept_ahead(ranked: DataFrame, k: int, first: int = 10) -> DataFrame:
    """The best ``k`` of a few hits (``doc_id``, ``score``, ``own``: true, or null for those that came in
    later).  Where there are ``first`` hits or more, those that came in later do not hold one of the
    first places while there is an own one behind them: they change places, best with best."""
    row = lambda *order: F.row_number().over(R.Window.partitionBy(F.lit(0)).orderBy(*order))
    placed = ranked.withColumn("own", F.coalesce("own", F.lit(False))).withColumn("place", row(F.col("score").desc(), F.col("own").desc(), "doc_id"))
    placed = written(placed, "placed", small=True)
    ahead = placed.filter((F.col("place") <= first) & ~F.col("own")).select(row("place").alias("pair"), F.col("place").alias("front"))
    behind = placed.filter((F.col("place") > first) & F.col("own")).select(row("place").alias("pair"), F.col("place").alias("back"))
    pairs = ahead.join(behind, "pair")
    moves = pairs.select(F.col("front").alias("place"), F.col("back").alias("to")).union(pairs.select("back", "front"))
    moved = placed.join(moves, "place", "left").withColumn("place", F.coalesce("to", "place"))
    head = F.when(F.col("place") <= first, F.col("score")).otherwise(F.lit(None))
    return X.top(moved, k, head.desc_nulls_last(), F.when(F.col("place") > first, F.col("place")).asc_nulls_first(), "doc_id").select("doc_id", "score")


def ask(docs: DataFrame, query: str, links: DataFrame, symbols: DataFrame, k: int = 10, index: TextIndex | None = None) -> DataFrame:
    """Hits of the symbol, text and lexical engines and of links, merged by confidence.

    A symbol of a word's name counts 1.0; where a word names none, those that sound alike do, 0.92
    at one edit and 0.55 at two.

    ``links`` has ``doc_id``, ``concept``; ``symbols`` has ``name``, ``doc_id``.  A document
    keeps its highest confidence; documents one concept away from the best four join behind
    them; equal texts keep one; then the relative cut-off.  Where nothing stands out
    (:func:`.retrieval.abstain`) there are no hits.  Reading changes no state.  With an
    ``index`` of ``docs`` only the texts of the best are read.
    """
    words = [w for w in dict.fromkeys(re.findall(r"\w+", query.lower())) if w not in T.QUESTION_STOPWORDS and (len(w) >= 3 or w.isdigit())]
    zero = F.lit(0).alias("query_id")
    stats = X.lexical_stats(index or docs, index.query_terms(words) if index else words)
    rarity = F.greatest(F.lit(0.0), F.log(F.col("n_docs") / F.col("df"))) / F.greatest(F.lit(1.0), F.log("n_docs"))
    held = stats.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.max(rarity).alias("rarity"), F.sum(F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    text = R.grep_confidence(held.select(zero, "doc_id", "n_terms", "rarity"), len(words))
    whole = F.greatest(F.max("idf").over(R.Window.partitionBy("query_id")), F.lit(1.0))
    top = X.top(held.select(zero, "doc_id", "n_terms", "idf"), 50, F.col("idf").desc(), "doc_id")
    meaning = R.semantic_confidence(top.withColumn("score", F.col("idf") / whole))
    asked = docs.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")).alias("word"))
    alike = X.fuzzy(asked, symbols.select(F.lower("name").alias("word")).distinct()).select(F.col("match").alias("low"), F.when(F.col("distance") == 0, 1.0).when(F.col("distance") == 1, 0.92).otherwise(0.55).alias("conf"))
    named = symbols.withColumn("low", F.lower("name")).join(alike, "low").groupBy("doc_id").agg(F.max("conf").alias("conf")).select(zero, "doc_id", "conf", F.lit("symbol").alias("engine"))
    linked = links.filter(F.col("concept").isin(*words)).select(zero, "doc_id", F.lit(0.90).alias("conf"), F.lit("link").alias("engine")).distinct()
    merged = R.abstain(R.candidate_merge(text, meaning, named, linked))
    seeds = X.top(merged, 4, F.col("conf").desc(), "doc_id").select("doc_id")
    bridge = concept_bridge(links, seeds).select(zero, "doc_id", F.lit(0.45).alias("conf"), F.lit("bridge").alias("engine")).distinct()
    best = X.top(R.candidate_merge(merged, bridge), 5 * k, F.col("conf").desc(), "doc_id")
    unique = X.content_dedup(docs.select("doc_id", "text").join(F.broadcast(best), "doc_id"))  # 5k rows
    return R.relative_cutoff(unique.select("query_id", "doc_id", "conf", "engine")).filter(F.col("rank") <= k).select("doc_id", "rank", "conf", "engine")
