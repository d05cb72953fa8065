"""Mixing sources to target weights by capped water-filling.

All steps are DataFrame operations.  Sources are clamped at ``most_epochs`` times their size
and the excess is dealt again in proportion to the weights; since ``cap / weight`` orders the
sources by the moment they saturate, the level that the repeated dealing ends at is read off
one pass over the sorted sources.  A source's target is then met by whole repetitions of all
its documents plus one fractional repetition: a seeded sample of whole documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, bounded, fresh, quoted, written


def cycle(*weights: int):
    """Weights dealt to the sources in code point order, repeating, a null source last."""

    def of(rank: Column) -> Column:
        return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))

    return of


def targets(sizes: DataFrame, weight=cycle(1, 2, 3), most_epochs: int = 3) -> DataFrame:
    """One row per source: its size and target.

    The two windows without a key run over the table of sources, one row each, after the
    documents have been summed with map-side combining.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    ordered = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    caps = ordered.withColumn("weight", weight(F.col("rank"))).withColumn("cap", F.col("source_size") * F.lit(float(most_epochs)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    levels = caps.withColumn("level", level).withColumn("at", F.row_number().over(by_ratio))
    free = F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct("at", "level"))
    found = levels.withColumn("met", F.min(free).over(every).getField("level"))
    target = F.when(F.col("met").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("met") * F.col("weight")))
    return found.withColumn("target", target).select("source", "source_size", "n_rows", "target")


ORDER_BITS = 60


def _order(seed: str) -> Column:
    """A document's place in the seeded order of its source: the first bits of an MD5 of seed and id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def _key(of: str = "") -> Column:
    """What orders the documents of a source: the seeded hash, then id and text where hashes are equal."""
    return F.struct(F.col(f"{of}h").alias("h"), F.coalesce(f"{of}doc_id", F.lit(-(1 << 63))).alias("id"), F.col(f"{of}sig").alias("sig"))


def _bucket(h: str = "h", bits: str = "bits") -> Column:
    return F.expr(f"shiftright({h}, {ORDER_BITS} - {bits})")


def _sizes(docs: DataFrame, seed: str) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sizes = texts.select("doc_id", "source", F.xxhash64("text").alias("sig"), F.regexp_count("text", F.lit(WORD_PATTERN)).cast("long").alias("size"), _order(seed).alias("h"))
    return written(sizes.withColumn("row", F.monotonically_increasing_id()), "sizes", narrow=True)


def _cuts(rows: DataFrame, weight, most_epochs: int) -> DataFrame:
    """One row per source: how often its documents are taken ``whole``, where its seeded sample
    ends (``last_bucket``, ``cut``), the row after it and the words ``missing`` there."""
    goal = (
        targets(rows, weight, most_epochs)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .withColumn("whole", F.least(F.floor("epochs"), F.lit(most_epochs)).cast("long"))
        .withColumn("quota", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("bits", F.least(F.lit(40), F.ceil(F.log2("n_rows") / 2)).cast("int"))
        .withColumnRenamed("source", "of")
    )
    goal = written(goal, "targets", small=True)
    full = rows.join(goal, F.col("source").eqNullSafe(F.col("of"))).withColumn("bucket", _bucket())
    sums = full.groupBy("of", "bucket").agg(F.sum("size").alias("bucket_size"), F.first("quota").alias("quota"))
    running = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("before", F.sum("bucket_size").over(running) - F.col("bucket_size"))
    ends = sums.filter((F.col("before") <= F.col("quota")) & (F.col("quota") < F.col("before") + F.col("bucket_size"))).select("of", F.col("bucket").alias("last_bucket"), "before")
    ends = written(ends, "ends", small=True)
    renamed = ends.select(F.col("of").alias("end_of"), "last_bucket", "before")
    inside = full.join(renamed, F.col("of").eqNullSafe(F.col("end_of")) & (F.col("bucket") == F.col("last_bucket")))
    within = Window.partitionBy("of", "bucket").orderBy(_key(), "row").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("sum", F.col("before") + F.sum("size").over(within))
    fits = F.when(F.col("sum") <= F.col("quota"), F.struct(_key().alias("key"), "row", F.col("sum").alias("sum")))
    beyond = F.when(F.col("sum") > F.col("quota"), F.struct(_key().alias("key"), "row"))
    cuts = inside.groupBy("of").agg(F.max(fits).alias("cut"), F.min(beyond).alias("next"), F.first("before").alias("before"))
    cuts = cuts.select(F.col("of").alias("cut_of"), "before", "cut", F.col("next.row").alias("next_row"))
    met = goal.join(ends.select(F.col("of").alias("end_of"), "last_bucket"), F.col("of").eqNullSafe(F.col("end_of")), "left").join(cuts, F.col("of").eqNullSafe(F.col("cut_of")), "left")
    missing = F.col("quota") - F.coalesce("cut.sum", "before")
    return written(met.select("of", "source_size", "target", "whole", "bits", "last_bucket", "cut", "next_row", missing.alias("missing")), "cuts", small=True)


def mixture(docs: DataFrame, weight=cycle(1, 2, 3), most_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """Decide how many words of each document enter the mix.

    The size of a document is its number of words; sources share the sum of all sizes by
    weight, none above ``most_epochs`` times its own size.  With ``e = target / source_size``
    each document is taken ``floor(e)`` times, and once more if it is in the seeded sample for
    the rest: documents in the order of an MD5 of seed and id as long as their sizes fit.  The
    next one gives the words that are still missing, a fractional repetition, so a source
    misses its target by less than a word.

    Returns per input row ``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` (words,
    repeats counted), ``repeats`` (whole ones) and ``sig`` (hash of the text).  Null and empty texts have
    size 0; a source of size 0 has target 0.  Null is a source of its own, the last one.  Rows
    repeating an id are decided one by one.  Reruns agree.  Empty tables give no rows.

    The order within a source of ``n`` rows is cut by the leading bits of the hash into about
    ``sqrt(n)`` buckets of ``sqrt(n)`` rows, so that no source, however large, is sorted in
    one task: only its bucket sums are, and the one bucket in which its sample ends.
    """
    rows = _sizes(docs, seed)
    cuts = _cuts(rows, weight, most_epochs)
    marked = rows.join(cuts, F.col("source").eqNullSafe(F.col("of"))).withColumn("bucket", _bucket())
    first = (F.col("bucket") < F.col("last_bucket")) | ((F.col("bucket") == F.col("last_bucket")) & (F.struct(_key().alias("key"), "row") <= F.struct("cut.key", "cut.row")))
    marked = marked.withColumn("chosen", F.coalesce(first, F.lit(False)))
    words = F.col("size") * F.col("whole") + F.when(F.col("chosen"), F.col("size")).when(F.col("row") == F.col("next_row"), F.floor("missing")).otherwise(0)
    return marked.select("doc_id", "size", "source_size", "target", words.alias("taken"), (F.col("whole") + F.col("chosen").cast("long")).alias("repeats"), "sig")


def mixed(docs: DataFrame, weight=cycle(1, 2, 3), most_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """The documents of the mix, all their columns, whole and as often as they are taken.

    As :func:`mixture`, but documents stay whole: in place of a fractional repetition the one
    document of the source whose size comes nearest to the missing words is taken once more, if
    that helps.  Rows that repeat both id and text are taken alike.  Null and empty texts have
    size 0 and are repeated with their source.  Columns of ``docs`` may have any names.  An empty
    table gives no rows.

    What is decided is one row per source, which a second scan of ``docs`` meets; no text is
    shuffled while the sources are few enough for a broadcast.
    """
    rows = _sizes(docs, seed)
    cuts = _cuts(rows, weight, most_epochs)
    taken = F.coalesce((F.col("bucket") < F.col("last_bucket")) | ((F.col("bucket") == F.col("last_bucket")) & (_key() <= F.col("cut.key"))), F.lit(False))
    marked = rows.join(cuts, F.col("source").eqNullSafe(F.col("of"))).withColumn("bucket", _bucket())
    near = F.struct(F.abs(F.col("missing") - F.col("size")).alias("gap"), _key().alias("key"))
    closing = marked.filter(~taken & (F.col("size") > 0)).groupBy("of").agg(F.min(near).alias("near"), F.first("missing").alias("missing"))
    closing = written(closing.filter("near.gap < missing").select(F.col("of").alias("close_of"), F.col("near.key").alias("close")), "closing", small=True)
    plan = cuts.select("of", "whole", "bits", "last_bucket", F.col("cut.key").alias("cut_key")).join(closing, F.col("of").eqNullSafe(F.col("close_of")), "left")
    plan = written(plan.select(F.struct("of", "whole", "bits", "last_bucket", "cut_key", "close").alias("plan")), "plan", small=True)
    named, own, copy = docs.columns, fresh(docs, "own"), fresh(docs, "copy")
    told = docs.withColumn(own, F.struct(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), _order(seed).alias("h"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("sig")))
    joined = told.select(F.struct(*[told[quoted(c)].alias(c) for c in named]).alias("d"), F.col(own).alias("o")).join(bounded(plan), F.col("o.source").eqNullSafe(F.col("plan.of")))
    key, bucket = _key("o."), _bucket("o.h", "plan.bits")
    again = (bucket < F.col("plan.last_bucket")) | ((bucket == F.col("plan.last_bucket")) & (key <= F.col("plan.cut_key")))
    again = F.coalesce(again, F.lit(False)) | F.coalesce(key == F.col("plan.close"), F.lit(False))
    repeats = F.col("plan.whole") + again.cast("long")
    out = joined.withColumn("repeats", repeats).filter("repeats > 0").withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))))
    return out.select("d.*")
