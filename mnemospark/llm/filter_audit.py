"""What each filter of a chain removes in every order of the chain, by lattice edges.

What a filter removes depends on which filters have run, not on their order.  So a document
counts on edges of the lattice of subsets: (filters applied so far, next filter).  Five filters
have 80 edges, and an order is a path of five of them from the empty set to all filters; the
120 orders' 600 steps read their figures off the edges.

Documents are first summed by part and by the set of filters they fail, with map-side
combining, so the 80 edges of a document are counted once for all documents alike.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE_CLASS, written


def standard_filters(text: Column) -> dict[str, Column]:
    """The conditions under which a text fails, by filter: A under 200 words; B fewer distinct
    words than half the words; C over 2 % capital letters; D one of ``#$%&*|``."""
    words = F.filter(F.split(text, f"{WHITE_CLASS}+"), lambda w: w != "")
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, filters=standard_filters) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``part`` (its source, null: empty) and ``mask``, a bit for
    each filter it fails.  The last bit is that of copies: texts of a smaller ``doc_id``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    flags = filters(F.col("text"))
    bits = [failed.cast("int") * F.lit(1 << k) for k, failed in enumerate(flags.values())]
    # a narrow row a document, of which all that follows is made; texts are read once
    rows = written(known.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("sig"), sum(bits, F.lit(0)).alias("bits")), "failures", narrow=True)
    repeated = rows.groupBy("sig").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1").select(F.col("sig").alias("of"), "first")
    repeated = written(repeated, "repeated", per_core=2)
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    met = rows.join(repeated, rows["sig"] == repeated["of"], "left")
    return met.select("doc_id", "part", (F.col("bits") + copy.cast("int") * F.lit(1 << len(flags))).alias("mask"))


def lattice(masks: DataFrame, n: int) -> DataFrame:
    """The edges: per part, set of filters applied (``subset``, a bit each) and next filter
    (``bit``) the sums over masks ``kept``, ``removed``, ``redundant``, ``good_lost`` and
    ``toxic_lost``.  ``masks`` has sums by part and mask, so at most ``2**n`` rows a part."""
    edges = masks.withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1)))).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    edges = edges.withColumn("bit", F.expr("shiftleft(1, at)")).filter(F.col("subset").bitwiseAND(F.col("bit")) == 0)
    there = F.col("mask").bitwiseAND(F.col("subset")) == 0
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    total = lambda where, what: F.sum(F.when(where, F.col(what)).otherwise(F.lit(0)))
    return edges.groupBy("part", "subset", "bit").agg(
        total(there & ~fails, "n").alias("kept"),
        total(there & fails, "n").alias("removed"),
        total(~there & fails, "n").alias("redundant"),
        total(there & fails, "good").alias("good_lost"),
        total(there & fails, "toxic").alias("toxic_lost"),
    )


def paths(names: str) -> list[tuple[str, int, int, int]]:
    """Every step of every order of the filters: the order, the step, the filters before it and
    its own, a bit each."""
    out = []
    for order in permutations(range(len(names))):
        subset = 0
        for step, k in enumerate(order, 1):
            out.append(("".join(names[x] for x in order), step, subset, 1 << k))
            subset |= 1 << k
    return out


def audit(docs: DataFrame, labels: DataFrame, filters=standard_filters, copies: str = "E") -> DataFrame:
    """What every filter does at every step of every order, per part.

    ``filters`` gives the conditions under which a text fails, by one-letter names; ``copies`` names
    one more, which texts fail that a smaller ``doc_id`` has as well, in any part, whether that
    document was removed or not.  Returns per ``part``, ``filter_order`` and ``step`` the documents
    ``kept`` after the step, ``removed`` by it, ``redundant`` (failing its filter, but gone before),
    ``unique_fails`` (failing its filter alone), ``good_lost`` and ``toxic_lost`` (removed by it,
    with that label), and ``shapley``, what its filter removes summed over all orders.

    Null texts count as empty; an empty text has no words and fails A only.  A null source is the
    empty one.  A row with a null id is never a copy, makes no other one, and has no label; rows
    that repeat an id are documents of their own, and not copies of each other.  Of labels that
    repeat an id any 1 counts; null labels count as 0.  Parts come from the documents, so an
    empty table gives no rows.  Words of one text are held together, as Spark holds the text.
    """
    names = "".join([*filters(F.col("text")), copies])
    n = len(names)
    marks = labels.select(F.col("doc_id").cast("long").alias("of"), (F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t")).filter("of is not null")
    marks = marks.groupBy("of").agg(F.coalesce(F.max("q"), F.lit(False)).cast("long").alias("good"), F.coalesce(F.max("t"), F.lit(False)).cast("long").alias("toxic"))
    rows = failures(docs, filters)
    met = rows.join(marks, rows["doc_id"] == marks["of"], "left")
    masks = met.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    edges = lattice(masks, n)
    filled = F.bit_count("subset")
    orders = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), filled + 1)
    of_filter = Window.partitionBy("part", "bit")
    alone = F.max(F.when(filled == n - 1, F.col("removed"))).over(of_filter)
    edges = edges.withColumns({"unique_fails": alone, "shapley": F.sum(F.col("removed") * orders).over(of_filter)})
    # n! * n rows whatever the input
    steps = docs.sparkSession.createDataFrame(paths(names), "filter_order string, step int, subset int, bit int")
    found = edges.join(F.broadcast(steps), ["subset", "bit"])
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
