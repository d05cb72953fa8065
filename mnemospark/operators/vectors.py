"""Vector search and statistics over embedding tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import blocks as B


def by_dimension(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    return vectors.select(key, F.posexplode(V.doubles(F.col(column))).alias("d", "x"))


def dimension_stats(vectors: DataFrame, column: str = "embedding", floor: float = 1e-6) -> DataFrame:
    """Per dimension the mean and the population standard deviation, at least ``floor``."""
    rows = vectors.select(F.posexplode(V.doubles(F.col(column))).alias("d", "x"))
    return rows.groupBy("d").agg(F.avg("x").alias("mean"), F.greatest(F.stddev_pop("x"), F.lit(floor)).alias("std"))


def whitening(stats: DataFrame) -> DataFrame:
    """One row: the means and deviations as arrays in the order of dimensions."""
    entry = F.array_sort(F.collect_list(F.struct("d", "mean", "std")))
    return stats.agg(entry.alias("s")).select(F.transform("s", lambda x: x["mean"]).alias("mean"), F.transform("s", lambda x: x["std"]).alias("std"))


def fingerprints(vectors: DataFrame, stats: DataFrame, column: str = "embedding") -> DataFrame:
    """Vectors with ``fp``, their sign bits about the corpus mean."""
    one = F.broadcast(whitening(stats))  # one row of two arrays, a value per dimension
    return vectors.crossJoin(one).withColumn("fp", V.sign_bits(V.doubles(F.col(column)), F.col("mean")))


def meeting(rows: DataFrame, queries: DataFrame, key: str, rows_per_block: int = 8192) -> DataFrame:
    """Every query with every row, block by block: rows are dealt to blocks by their key and
    each block meets the queries, so no side is broadcast whatever its size.  Blocks have partitions
    by number: they are small in bytes, and Spark would put many into one task."""
    n = rows.count()
    blocks = max(1, -(-n // rows_per_block), min(4 * rows.sparkSession.sparkContext.defaultParallelism, n // 512))
    dealt = rows.withColumn("__block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    asked = queries.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return dealt.repartition(blocks, "__block").join(asked.repartition(blocks, "__block").hint("shuffle_hash"), "__block").drop("__block")


def nearest(rows: DataFrame, queries: DataFrame, score: Column, k: int, key: str = "vec_id", query: str = "query_id", descending: bool = True) -> DataFrame:
    """``query``, ``rank``, ``key``, ``score`` of the ``k`` best rows, ties to the smaller key."""
    scored = meeting(rows, queries, key).filter(F.col(query) != F.col(key)).select(query, key, score.alias("score"))
    order = F.col("score").desc() if descending else F.col("score").asc()
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(order, key))).filter(F.col("rank") <= k)


def mad_scale(vectors: DataFrame, column: str = "embedding", bins: int = 4096) -> DataFrame:
    """Per dimension twice the median distance from the mean (upper median), within 0.05..0.5.

    The exact median without sorting a dimension: a histogram, summed before it is shuffled, tells
    the bin that holds it, and only the distinct values of that bin are ranked.
    """
    rows = vectors.select(F.posexplode(V.doubles(F.col(column))).alias("d", "x"))
    stats = dimension_stats(vectors, column).select("d", "mean")
    far = rows.join(F.broadcast(stats), "d").select("d", F.abs(F.col("x") - F.col("mean")).alias("far"))  # a row per dimension
    ends = far.groupBy("d").agg(F.max("far").alias("most"), (F.floor(F.count("*") / 2) + 1).alias("want"))
    place = F.when(F.col("most") > 0, F.least(F.floor(F.col("far") / F.col("most") * bins), F.lit(bins - 1))).otherwise(0)
    placed = far.join(F.broadcast(ends), "d").withColumn("bin", place)  # a row per dimension
    upto = lambda order: F.sum("n").over(Window.partitionBy("d").orderBy(order))
    counts = placed.groupBy("d", "want", "bin").agg(F.count("*").alias("n")).withColumn("upto", upto("bin"))
    middle = counts.filter((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want"))).select("d", "bin", (F.col("want") - F.col("upto") + F.col("n")).alias("left"))
    inside = placed.join(F.broadcast(middle), ["d", "bin"]).groupBy("d", "left", "far").agg(F.count("*").alias("n")).withColumn("upto", upto("far"))  # a row per dimension
    found = inside.filter((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("n") < F.col("left")))
    return found.select("d", F.least(F.greatest(2 * F.col("far"), F.lit(0.05)), F.lit(0.5)).alias("scale"))


def mean_pool(rows: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """Per key the mean of its unit vectors, of length one again."""
    parts = rows.select(key, V.unit(V.doubles(F.col(column))).alias("x")).select(key, F.posexplode("x").alias("d", "x"))
    means = parts.groupBy(key, "d").agg(F.avg("x").alias("x"))
    return means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("s")).select(key, V.unit(F.transform("s", lambda v: v["x"])).alias("embedding"))


def max_similarity(passages: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """``query_id``, ``key``, ``score``: the best dot product of any passage of a key."""
    return B.max_dots(passages.select(key, "vec_id", V.doubles(F.col("embedding")).alias("x")), queries, key)


def drift(stats: DataFrame, asked: DataFrame, rate: float = 0.05, least: int = 10) -> DataFrame:
    """Corpus statistics moved towards the mean of the questions asked, once there are enough:
    a mean goes ``rate`` of the way, a deviation towards half the distance, never under itself."""
    of = asked.select(F.posexplode(V.doubles(F.col("embedding"))).alias("d", "x")).groupBy("d").agg(F.avg("x").alias("q"), F.count("*").alias("n"))
    moved = F.col("n") >= least
    far = F.abs(F.col("q") - F.col("mean"))
    mean = F.when(moved, F.col("mean") + rate * (F.col("q") - F.col("mean"))).otherwise(F.col("mean"))
    std = F.when(moved, F.col("std") + rate * (F.greatest("std", 0.5 * far) - F.col("std"))).otherwise(F.col("std"))
    return stats.join(F.broadcast(of), "d", "left").select("d", mean.alias("mean"), std.alias("std"))  # a row per dimension
