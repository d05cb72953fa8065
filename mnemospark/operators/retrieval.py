"""Ranking, fusion and gating of hits.

Hits are rows ``query_id``, ``doc_id`` and a score or confidence.  Everything is computed for
all queries of a batch at once; windows are partitioned by query.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by_query(*order: Column | str) -> Window:
    return Window.partitionBy("query_id").orderBy(*order)


def candidate_merge(*engines: DataFrame) -> DataFrame:
    """Hits of several engines (``query_id``, ``doc_id``, ``conf``, ``engine``): a document
    keeps its highest confidence and that engine's name."""
    hits = reduce(DataFrame.unionByName, engines)
    best = F.max_by("engine", F.struct("conf", "engine"))
    return hits.groupBy("query_id", "doc_id").agg(F.max("conf").alias("conf"), best.alias("engine"))


def rrf(*ranked: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of hits with 0-based ``rank``: sum of ``weight / (k + rank)``;
    an engine without a ``weight`` column counts 1."""
    parts = [x.select("query_id", "doc_id", ((F.col("weight") if "weight" in x.columns else F.lit(1.0)) / (k + F.col("rank"))).alias("part")) for x in ranked]
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))


def inject(hits: DataFrame, specific: DataFrame) -> DataFrame:
    """Specific documents (``query_id``, ``doc_id``, ``mentions``): absent ones enter at 0.8 of
    the query's best score, present ones gain 0.2 of it per mention."""
    top = hits.groupBy("query_id").agg(F.max("score").alias("top"))
    joined = hits.join(specific, ["query_id", "doc_id"], "full_outer").join(top, "query_id")
    present = F.col("score") + F.coalesce("mentions", F.lit(0)) * 0.2 * F.col("top")
    return joined.select("query_id", "doc_id", F.when(F.col("score").isNull(), 0.8 * F.col("top")).otherwise(present).alias("score"))


def smart_gate(hits: DataFrame, least: int = 50) -> DataFrame:
    """All hits with a lexical match, and semantic ones until there are ``least``."""
    n_lexical = F.count_if("lexical").over(Window.partitionBy("query_id"))
    ranked = hits.withColumn("rank", F.row_number().over(_by_query(F.col("lexical").desc(), F.col("score").desc(), "doc_id"))).withColumn("n_lexical", n_lexical)
    return ranked.filter(F.col("rank") <= F.greatest("n_lexical", F.lit(least))).drop("n_lexical")


def relative_cutoff(hits: DataFrame, share: float = 0.30, always: int = 3) -> DataFrame:
    """The first ``always`` hits, then those of at least ``share`` of the best confidence."""
    top = F.max("conf").over(Window.partitionBy("query_id"))
    ranked = hits.withColumn("rank", F.row_number().over(_by_query(F.col("conf").desc(), "doc_id"))).withColumn("top", top)
    return ranked.filter((F.col("rank") <= always) | (F.col("conf") >= share * F.col("top"))).drop("top")


def abstain(hits: DataFrame, floor: float = 0.05, gap: float = 0.20, k: int = 10, least_z: float = 1.0) -> DataFrame:
    """Drop weak semantic hits, or all of a query's if nothing stands out.

    Semantic hits under ``floor`` go (the best one stays if nothing is left); beyond rank ``k``
    those over ``gap`` behind the best go; with four or more semantic hits and no lexical one of
    0.55, a best score less than ``least_z`` deviations over their mean leaves the query empty.
    """
    q = Window.partitionBy("query_id")
    ranked = hits.withColumn("rank", F.row_number().over(_by_query(F.col("conf").desc(), "doc_id"))).withColumn("top", F.max("conf").over(q))
    semantic = F.col("engine") == "semantic"
    kept = ranked.filter((F.col("rank") == 1) | ~semantic | ((F.col("conf") >= floor) & ((F.col("rank") <= k) | (F.col("top") - F.col("conf") <= gap))))
    scores = F.when(semantic, F.col("conf"))
    stats = kept.withColumn("n", F.count(scores).over(q)).withColumn("mean", F.avg(scores).over(q)).withColumn("dev", F.stddev_pop(scores).over(q))
    stats = stats.withColumn("sure", F.max(F.when(~semantic, F.col("conf")).otherwise(0.0)).over(q) >= 0.55)
    flat = (F.col("n") >= 4) & ~F.col("sure") & (F.when(F.col("dev") > 0, (F.col("top") - F.col("mean")) / F.col("dev")).otherwise(0.0) < least_z)
    return stats.filter(~flat).select("query_id", "doc_id", "conf", "engine")


def tied(hits: DataFrame) -> DataFrame:
    """Hits within 0.05 of a best one under 0.95 that leads by at most 0.03, if three or more."""
    w = _by_query(F.col("conf").desc(), "doc_id")
    ranked = hits.withColumn("rank", F.row_number().over(w)).withColumn("top", F.first("conf").over(w)).withColumn("second", F.max(F.when(F.col("rank") == 2, F.col("conf"))).over(Window.partitionBy("query_id")))
    near = ranked.filter((F.col("top") < 0.95) & (F.col("top") - F.col("second") <= 0.03) & (F.col("conf") >= F.col("top") - 0.05))
    return near.withColumn("n", F.count("*").over(Window.partitionBy("query_id"))).filter("n >= 3").select("query_id", "doc_id", "conf", "n")


def tie_facets(ties: DataFrame, tags: DataFrame, most: int = 6) -> DataFrame:
    """Tags that some but not all tied hits of a query have, the most common first."""
    counts = ties.join(tags, "doc_id").groupBy("query_id", "tag").agg(F.count_distinct("doc_id").alias("k"), F.first("n").alias("n")).filter("k < n")
    return counts.withColumn("rank", F.row_number().over(_by_query(F.col("k").desc(), "tag"))).filter(F.col("rank") <= most).select("query_id", "tag", "k")


def passage_blend(whole: DataFrame, passages: DataFrame) -> DataFrame:
    """Document scores (``own``) raised by their passages: the larger of the score itself and
    half of it plus half the best passage, half the number of passages and 0.05 of the sum of
    the three best."""
    best3 = F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, 3)
    by_doc = passages.groupBy("query_id", "doc_id").agg(F.max("score").alias("best"), F.count("*").alias("n"), F.aggregate(best3, F.lit(0.0), lambda a, x: a + x).alias("top3"))
    blend = 0.5 * F.col("own") + 0.5 * F.col("best") + 0.5 * F.col("n") + 0.05 * F.col("top3")
    return whole.join(by_doc, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.greatest("own", F.coalesce(blend, F.col("own"))).alias("score"))


def hybrid(semantic: DataFrame, lexical: DataFrame, least: int = 50) -> DataFrame:
    """``0.60 * semantic + 0.40 * lexical``; without a lexical match a document is ranked as if
    its semantic score were 0.4 and carries none.  Keeps the lexical hits, ``least`` at least."""
    joined = semantic.join(lexical, ["query_id", "doc_id"], "left")
    matched = F.col("lex").isNotNull()
    score = F.when(matched, 0.60 * F.col("sem") + 0.40 * F.col("lex")).otherwise(F.lit(0.60 * 0.4))
    rows = joined.select("query_id", "doc_id", score.alias("score"), matched.alias("lexical"), F.when(matched, F.col("sem")).otherwise(0.0).alias("sem"))
    return smart_gate(rows, least).select("query_id", "doc_id", "score", "sem")


def full_hybrid(postings: DataFrame, semantic: DataFrame) -> DataFrame:
    """The full score from postings (``query_id``, ``doc_id``, ``term``, ``tf``, ``idf``,
    ``length``, ``mean_length``, and the query's ``idf_mean`` and ``rare_share``) and semantic
    scores: rare and common terms saturate and are weighted apart, and the share of meaning
    against words follows how much of the query's idf the matched words carry.

    Phrase, density and entity parts need the text and are separate operators.
    """
    e = F.least(F.greatest(0.7 * F.least(F.greatest((F.col("idf_mean") - 1.2) / 1.2, F.lit(0.0)), F.lit(1.0)) + 0.3 * F.col("rare_share"), F.lit(0.0)), F.lit(1.0))
    p = postings.withColumn("e", e)
    k1 = 1.5 + 1.5 * (1 - F.col("e"))
    p = p.withColumn("w", F.col("tf") * k1 / (F.col("tf") + k1) * F.pow("idf", 1 + 0.15 * F.col("e")))
    rare = F.col("idf") > 2.5
    by_doc = p.groupBy("query_id", "doc_id").agg(
        F.sum(F.when(rare, F.col("w")).otherwise(0.0)).alias("rare"),
        F.sum(F.when(~rare, F.col("w")).otherwise(0.0)).alias("common"),
        F.avg("idf").alias("overlap"),
        *[F.first(c).alias(c) for c in ("e", "idf_mean", "length", "mean_length")],
    )
    share = 0.60 + 0.15 * F.col("e")
    r = F.least((share * F.col("rare") + (1 - share) * F.col("common")) / 10, F.lit(1.0))
    lex = r * (1 + r * r) / F.greatest(0.65 + 0.35 * F.col("length") / F.col("mean_length"), F.lit(0.5))
    dialogue = F.when(F.col("e") < 0.3, F.least(0.35 * (1 - F.col("e")), F.lit(0.35))).otherwise(0.0)
    alpha = F.least(F.greatest(F.least(1 - F.col("overlap") / F.greatest("idf_mean", F.lit(0.001)), F.lit(1.0)), F.lit(0.0)) + dialogue, F.lit(1.0))
    scored = by_doc.select("query_id", "doc_id", lex.alias("lex"), alpha.alias("alpha"))
    joined = semantic.join(scored, ["query_id", "doc_id"], "left")
    weight = F.coalesce("alpha", F.lit(1.0))
    return joined.select("query_id", "doc_id", (weight * F.col("sem") + (1 - weight) * F.coalesce("lex", F.lit(0.0))).alias("score"))


def champions(postings: DataFrame, semantic: DataFrame, depth: int = 50) -> DataFrame:
    """:func:`full_hybrid` of each query's ``depth`` best by meaning only, ties to the smaller id;
    postings of other documents are dropped before they are scored."""
    best = Window.partitionBy("query_id").orderBy(F.col("sem").desc(), "doc_id")
    few = semantic.withColumn("__rank", F.row_number().over(best)).filter(F.col("__rank") <= depth).drop("__rank")
    return full_hybrid(postings.join(F.broadcast(few.select("query_id", "doc_id")), ["query_id", "doc_id"], "left_semi"), few)  # depth rows a query


def float_hybrid(postings: DataFrame, semantic: DataFrame, weight: float = 0.5) -> DataFrame:
    """The variant with fixed 70/30 weights for rare and common terms and BM25 saturation."""
    norm = F.greatest(0.65 + 0.35 * F.col("length") / F.col("mean_length"), F.lit(0.5))
    w = F.col("idf") * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * norm)
    rare = F.col("idf") > 2.5
    by_doc = postings.withColumn("w", w).groupBy("query_id", "doc_id").agg(F.sum(F.when(rare, 0.7 * F.col("w")).otherwise(0.3 * F.col("w"))).alias("t"))
    r = F.least(F.col("t") / 10, F.lit(1.0))
    joined = semantic.join(by_doc.select("query_id", "doc_id", (r * (1 + r * r)).alias("lex")), ["query_id", "doc_id"], "left")
    return joined.select("query_id", "doc_id", (weight * F.col("sem") + (1 - weight) * F.coalesce("lex", F.lit(0.0))).alias("score")).filter("score > 0")


def query_route(stats: DataFrame) -> DataFrame:
    """Route per query from ``n_words``, ``idf_avg``, ``idf_max``, ``oov`` (share of unknown
    words) and ``code`` (a word looks like a code or asks for one)."""
    plain = (F.col("n_words") <= 8) & (F.col("idf_avg") <= 1.2) & (F.col("idf_max") <= 2.5) & (F.col("oov") < 0.1)
    route = F.when(F.col("n_words") == 0, "semantic").when(F.col("code"), "lexical").when(plain | (F.col("oov") >= 0.8), "semantic").otherwise("hybrid")
    return stats.select("query_id", route.alias("route"))


def ndcg(hits: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """NDCG@k per query: gain ``2**rel - 1``, discount ``log2(rank + 2)`` with ranks from 0."""
    gain = lambda rel, rank: (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 2)
    ranked = hits.withColumn("rank", F.row_number().over(_by_query(F.col("score").desc(), "doc_id")) - 1).filter(F.col("rank") < k)
    got = ranked.join(qrels, ["query_id", "doc_id"]).groupBy("query_id").agg(F.sum(gain(F.col("rel"), F.col("rank"))).alias("dcg"))
    best = qrels.filter("rel > 0").withColumn("rank", F.row_number().over(_by_query(F.col("rel").desc(), "doc_id")) - 1).filter(F.col("rank") < k)
    ideal = best.groupBy("query_id").agg(F.sum(gain(F.col("rel"), F.col("rank"))).alias("ideal"))
    every = hits.select("query_id").union(qrels.select("query_id")).distinct()
    joined = every.join(got, "query_id", "left").join(ideal, "query_id", "left")
    return joined.select("query_id", F.when(F.coalesce("ideal", F.lit(0.0)) > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def needle(hits: DataFrame, keyword_hits: DataFrame) -> DataFrame:
    """Scores plus 1000 per keyword hit of a document."""
    joined = hits.join(keyword_hits, ["query_id", "doc_id"], "full_outer")
    return joined.select("query_id", "doc_id", (F.coalesce("score", F.lit(0.0)) + 1000 * F.coalesce("n", F.lit(0))).alias("score"))


def grep_confidence(hits: DataFrame, terms: int) -> DataFrame:
    """Confidence of text hits from the number of query terms a document holds and the rarity
    of what it matched: 0.40 and 0.15 a term up to 0.95; complete ones gain by rarity."""
    base = F.least(F.lit(0.95), 0.40 + 0.15 * (F.col("n_terms") - 1))
    whole = F.least(F.lit(0.80), base + 0.10 * F.col("rarity"))
    rare = F.least(F.lit(0.99), 0.95 + 0.04 * F.col("rarity"))
    conf = F.when((F.col("n_terms") == 1) & (F.col("rarity") >= 0.85), rare).when(F.col("n_terms") == terms, F.greatest(base, whole)).otherwise(base)
    return hits.select("query_id", "doc_id", conf.alias("conf"), F.lit("text").alias("engine"))


def semantic_confidence(hits: DataFrame, trusted: int = 10) -> DataFrame:
    """Confidence of semantic hits (``score``, ``n_terms`` of the query they hold); ranks from
    ``trusted`` on need a term."""
    ranked = hits.withColumn("rank", F.row_number().over(_by_query(F.col("score").desc(), "doc_id")) - 1).filter((F.col("rank") < trusted) | (F.col("n_terms") > 0))
    conf = F.least(F.lit(0.80), 0.30 + F.least(F.greatest(0.30 * F.col("score"), F.lit(0.0)), F.lit(0.30)) + 0.05 * F.greatest(F.lit(0), F.col("n_terms") - 1))
    return ranked.select("query_id", "doc_id", conf.alias("conf"), F.lit("semantic").alias("engine"))


def fix_score(fixes: DataFrame, least: float = 0.0) -> DataFrame:
    """``rel * (0.3 + 0.4 * sem + 0.3 * intent)``, with ``sem`` the better of cosine and
    fingerprint similarity; the best fix, and others at 0.05.  Scores equal to nine places are
    ties, to the smaller ``doc_id``, however their doubles were summed."""
    score = F.col("rel") * (0.3 + 0.4 * F.greatest("cos", "fp") + 0.3 * F.col("intent"))
    ranked = fixes.withColumn("raw", score).filter(F.col("raw") >= least).withColumn("rank", F.row_number().over(_by_query(F.round("raw", 9).desc(), "doc_id")))
    return ranked.select("query_id", "doc_id", "rank", F.when(F.col("rank") == 1, F.col("raw")).otherwise(0.05).alias("score"))


def blueprint_score(rows: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """The scorer of :func:`fix_score` over blueprints: the best ``k`` of each query from ``least``,
    each with its own score."""
    score = F.round(F.col("rel") * (0.3 + 0.4 * F.greatest("cos", "fp") + 0.3 * F.col("intent")), 9)
    ranked = rows.withColumn("score", score).filter(F.col("score") >= least).withColumn("rank", F.row_number().over(_by_query(F.col("score").desc(), "doc_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "doc_id", "rank", "score")


def blueprints(shapes: DataFrame) -> DataFrame:
    """Named shapes of work (``seq``, ``shape``, ``lang``, ``content``) as documents: ``doc_id`` from shape
    and language, the first of each, tagged."""
    doc_id = F.lower(F.concat_ws(":", F.lit("blueprint"), "shape", "lang"))
    first = shapes.groupBy(doc_id.alias("doc_id")).agg(F.min_by("content", "seq").alias("content"), F.min("lang").alias("lang"))
    return first.select("doc_id", "content", F.array_compact(F.array(F.lit("blueprint"), F.concat(F.lit("lang:"), "lang"))).alias("tags"))


def learned(have: DataFrame, new: DataFrame, overwrite: bool = False) -> DataFrame:
    """The blueprints to write: those not there yet, since edits of the others are kept, or all."""
    return new if overwrite else new.join(have.select("doc_id"), "doc_id", "left_anti")


def federated(stores: Sequence[DataFrame], k: int) -> DataFrame:
    """The best ``k`` of several stores' hits; a document in more than one keeps its best."""
    best = reduce(DataFrame.unionByName, stores).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(_by_query(F.col("score").desc(), "doc_id"))).filter(F.col("rank") <= k)


def authority(hits: DataFrame, multipliers: dict[str, float], k: int) -> DataFrame:
    """Scores times their pillar's multiplier, the best per document, the best ``k``."""
    factor = F.coalesce(F.create_map(*[F.lit(x) for pair in multipliers.items() for x in pair])[F.col("pillar")], F.lit(1.0))
    return federated([hits.select("query_id", "doc_id", (F.col("score") * factor).alias("score"))], k)


def span_density(positions: DataFrame) -> DataFrame:
    """``(sum of idf)**1.5 / (ln(span) + 1)`` of the shortest stretch of a document that holds
    all its matched terms (``query_id``, ``doc_id``, ``term``, ``pos``, ``idf``), from two terms.

    For each position the stretch back to the latest occurrence of every other term is known
    from one running window per term, so no pairs of positions are formed.
    """
    terms = F.array_sort(F.collect_set(F.struct("term", "idf")))
    rows = positions.groupBy("query_id", "doc_id").agg(terms.alias("terms"), F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("hits")).filter(F.size("terms") >= 2)
    empty = F.struct(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")).alias("last"), F.lit(None).cast("int").alias("best"))

    def step(acc: Column, hit: Column) -> Column:
        last = F.map_concat(F.map_filter(acc["last"], lambda k, _: k != hit["term"]), F.create_map(hit["term"], hit["pos"].cast("int")))
        span = F.when(F.size(last) == F.size("terms"), hit["pos"].cast("int") - F.array_min(F.map_values(last)) + 1)
        return F.struct(last.alias("last"), F.least(acc["best"], span).alias("best"))

    span = F.aggregate("hits", empty, step, lambda acc: acc["best"])
    idf = F.aggregate("terms", F.lit(0.0), lambda a, t: a + t["idf"])
    return rows.select("query_id", "doc_id", span.alias("span"), (F.pow(idf, F.lit(1.5)) / (F.log(F.greatest(span, F.lit(1))) + 1)).alias("density"))
