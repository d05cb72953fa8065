"""Clusters of vectors, stored cells, and search that reads a part of the rows.

Centres (a few hundred rows) are the only thing the driver holds.  A pass over the vectors is a
job whose tasks turn record batches into one matrix each and leave a row per centre, whatever
they have read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..scratch import written
from . import blocks


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rounded so that equal ones are equal however they were summed."""
    far = (x * x).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(axis=1)
    return np.round(np.maximum(far, 0), 12)


def _sums(rows: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many rows are nearest to each centre, and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centres), np.int64), np.zeros(centres.shape)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                at = squares(x, centres).argmin(axis=1)
                counts += np.bincount(at, minlength=len(centres))
                np.add.at(sums, at, x)
        yield pa.record_batch({"c": pa.array(np.arange(len(centres)), pa.int32()), "n": pa.array(counts), "s": pa.array(sums.tolist(), pa.list_(pa.float64()))})

    parts = rows.select("x").mapInArrow(run, "c int, n long, s array<double>").groupBy("c")
    found = parts.agg(F.sum("n"), *[F.sum(F.get("s", F.lit(d))) for d in range(centres.shape[1])]).collect()
    counts, sums = np.zeros(len(centres), np.int64), np.zeros(centres.shape)
    for r in found:
        counts[r[0]], sums[r[0]] = r[1], r[2:]
    return counts, sums


def _far(rows: DataFrame, centres: np.ndarray, many: int, seed: str) -> np.ndarray:
    """``many`` rows drawn without replacement, weighted by the squared distance to the nearest
    centre: those with the smallest exponential variates of that rate, from a hash of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = squares(matrix(batch.column(0)), centres).min(axis=1)
                u = (batch.column(1).to_numpy() % (1 << 52) + 0.5) / (1 << 52)
                with np.errstate(divide="ignore"):
                    late = np.where(near > 0, -np.log(u) / near, np.inf)
                yield pa.record_batch({"x": batch.column(0), "late": pa.array(late)})

    told = rows.select("x", F.xxhash64("key", F.lit(seed))).mapInArrow(run, "x array<double>, late double")
    return np.array([r.x for r in told.filter("late < double('Infinity')").orderBy("late", "x").limit(many).collect()])


def seeds(rows: DataFrame, k: int, passes: int = 3) -> np.ndarray:
    """``k`` centres to begin with, or fewer where there are fewer distinct rows: a few passes over
    all rows draw ``2 k`` candidates each, far from those there are; candidates are weighted by
    the rows nearest to them, and of these few hundred the seeds are drawn on the driver."""
    first = rows.orderBy(F.xxhash64("key"), "key").limit(1).collect()
    if not first:
        return np.zeros((0, 0))
    found = np.array([first[0].x])
    for step in range(passes):
        more = _far(rows, found, 2 * k, f"seed-{step}")
        if not len(more):
            break
        found = np.unique(np.concatenate((found, more)), axis=0)
    weights = _sums(rows, found)[0].astype(float)
    rng = np.random.default_rng(1)
    chosen = [int(weights.argmax())]
    while len(chosen) < min(k, len(found)):
        near = squares(found, found[chosen]).min(axis=1) * weights
        if not near.sum():
            break
        chosen.append(int(rng.choice(len(found), p=near / near.sum())))
    return found[chosen]


def kmeans(vectors: DataFrame, k: int = 32, rounds: int = 50, tolerance: float = 1e-4, key: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, list[list[float]]]:
    """Clusters by squared distance: ``key``, ``cluster``, and the centres.

    All rows decide on seeds (:func:`seeds`) and on every round, one job each; rounds end once no
    centre moves by ``tolerance``.  A cluster that loses all rows keeps its centre.  Reruns agree.
    """
    rows = written(vectors.select(F.col(key).alias("key"), V.doubles(F.col(column)).alias("x")).filter("x is not null"), "vectors", per_core=2)
    centres = seeds(rows, k)
    if not len(centres):
        return rows.select(F.col("key").alias(key), F.lit(0).alias("cluster")), []
    for _ in range(rounds):
        counts, sums = _sums(rows, centres)
        moved = np.where(counts[:, None] > 0, np.round(sums / np.maximum(counts, 1)[:, None], 12), centres)
        shift = float(np.sqrt(((moved - centres) ** 2).sum(axis=1)).max())
        centres = moved
        if shift < tolerance:
            break
    return placed(rows.withColumnRenamed("key", key), centres, key).select(key, F.col("cell").alias("cluster")), centres.tolist()


def placed(rows: DataFrame, centres: np.ndarray, key: str, cells: int = 1) -> DataFrame:
    """``key``, ``x``, ``cell``: rows with their ``cells`` nearest centres, a row for each."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = np.argsort(squares(matrix(batch.column(1)), centres), axis=1, kind="stable")[:, :cells]
                take = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                yield pa.record_batch({key: batch.column(0).take(take), "x": batch.column(1).take(take), "cell": pa.array(near.ravel(), pa.int32())})

    return rows.select(key, "x").mapInArrow(run, f"`{key}` {kind}, x array<double>, cell int")


def store_cells(vectors: DataFrame, centres: list[list[float]], path: str, key: str = "vec_id", column: str = "embedding") -> None:
    """Every vector in the folder of its cell; a cell too large for a task is split."""
    rows = vectors.select(key, V.doubles(F.col(column)).alias("x")).filter("x is not null")
    placed(rows, np.array(centres), key).hint("rebalance", "cell").write.option("compression", "zstd").partitionBy("cell").parquet(path)


def cell_search(stored: DataFrame, centres: list[list[float]], queries: DataFrame, probe: int, k: int, key: str = "vec_id") -> DataFrame:
    """``query_id``, ``rank``, ``key``, ``score``: the ``k`` best by dot product among the vectors in
    the ``probe`` cells nearest each query (``query_id``, ``q``).  Only those cells are read, and each
    meets its queries in blocks (:mod:`.blocks`)."""
    near = written(placed(queries.withColumnRenamed("q", "x"), np.array(centres), "query_id", probe).withColumnRenamed("x", "q"), "probes", per_core=1)
    cells = [r.cell for r in near.select("cell").distinct().collect()]  # as many as there are centres
    left, right = blocks.dealt(stored.filter(F.col("cell").isin(cells)), near, key, per=("cell", max(1, len(centres))))
    return blocks.top_k(left, right, ["cell", "row_block", "query_block"], blocks.dots, k, 12, key)


def associations(vectors: DataFrame, order: str, decay: float = 0.999, column: str = "embedding") -> DataFrame:
    """``i``, ``j``, ``value`` of the decayed sum of outer products of vectors in order.

    ``S <- decay * S + e e'`` over n vectors is ``sum of decay**(n - k) e_k e_k'``: a product of
    matrices for each record batch, one d x d sum for each task.  A vector's age is its distance
    in ``order`` from the last one, so order has to count without gaps.
    """
    last = F.broadcast(vectors.agg(F.max(order).alias("__last")))  # one row
    rows = vectors.crossJoin(last).select(F.pow(F.lit(decay), F.col("__last") - F.col(order)).alias("w"), V.doubles(F.col(column)).alias("x")).filter("x is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                found = (x * batch.column(0).to_numpy()[:, None]).T @ x
                total = found if total is None else total + found
        if total is not None:
            d = len(total)
            yield pa.record_batch({"i": pa.array(np.repeat(np.arange(d), d), pa.int32()), "j": pa.array(np.tile(np.arange(d), d), pa.int32()), "value": pa.array(total.ravel())})

    return rows.mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))


def hamming_nearest(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", bits: int | None = None) -> DataFrame:
    """``query_id``, ``rank``, ``key``, ``score``: the ``k`` rows (``key``, ``fp``) nearest each query
    (``query_id``, ``q``) by bits that differ, itself not included, ties to the smaller key; and
    ``probed``, the codes that were compared for the query.

    Exact, and no row meets every query.  Fingerprints are cut into segments of about log2(n)
    bits.  Round r looks up the segments that differ from the query's in r bits.  What is in
    none of the rounds up to r differs in over r bits of every segment, so a query is done once
    its k-th hit is nearer than that.  Rows are grouped by fingerprint first, with the smallest
    ``k`` + 1 keys of each, so copies neither fill buckets nor displace each other.
    """
    n = rows.count()
    bits = bits or min(20, max(4, ceil(log2(max(n, 2)))))
    segments = [(at, min(bits, 64 - at)) for at in range(0, 64, bits)]
    ranked = rows.select(key, "fp").withColumn("r", F.row_number().over(Window.partitionBy("fp").orderBy(key))).filter(F.col("r") <= k + 1)
    codes = written(ranked.groupBy("fp").agg(F.array_sort(F.collect_list(key)).alias("keys")), "codes", per_core=2)
    cut = lambda code: F.array(*[F.struct(F.lit(s).alias("seg"), F.shiftrightunsigned(code, at).bitwiseAND(F.lit((1 << w) - 1)).alias("value")) for s, (at, w) in enumerate(segments)])
    index = written(codes.select("fp", F.explode(cut(F.col("fp"))).alias("c")).select("fp", "c.seg", "c.value"), "segments", per_core=4)
    active = written(queries.select("query_id", "q"), "asked", per_core=1)
    done, found = [], None
    for radius in range(bits + 1):
        # a table, since there may be many thousands: as literals they would fill the driver's plans
        masks = rows.sparkSession.range(1 << bits).filter(F.bit_count("id") == radius).withColumnRenamed("id", "mask")
        asked = active.select("query_id", "q", F.explode(cut(F.col("q"))).alias("c"))
        turned = asked.crossJoin(F.broadcast(masks)).select("query_id", "q", "c.seg", F.col("mask").bitwiseXOR(F.col("c.value")).alias("value"))  # at most 2**20 longs
        met = turned.join(index, ["seg", "value"]).select("query_id", "q", "fp").distinct()
        if found is not None:
            met = met.join(found.select("query_id", "fp"), ["query_id", "fp"], "left_anti")
        new = met.select("query_id", "fp", F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))).cast("int").alias("score"), F.lit(radius).alias("round"))
        found = written(new if found is None else found.join(active.select("query_id"), "query_id", "left_semi").union(new), "found", per_core=2)
        best = found.join(codes, "fp").select("query_id", "score", F.explode("keys").alias(key)).filter(F.col(key) != F.col("query_id"))
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", key))).filter(F.col("rank") <= k)
        best = written(best.join(found.groupBy("query_id").agg(F.count("*").alias("probed")), "query_id"), "best", per_core=1)
        last = radius == bits
        ready = active.select("query_id") if last else best.filter((F.col("rank") == k) & (F.col("score") < len(segments) * (radius + 1))).select("query_id")
        done.append(best.join(ready, "query_id", "left_semi").select("query_id", "rank", key, "score", "probed"))
        active = written(active.join(ready, "query_id", "left_anti"), "asked", per_core=1)
        if last or active.isEmpty():
            break
        # where more lookups than codes would follow, the rest is compared in blocks
        if comb(bits, radius + 1) * len(segments) > max(n, 1):
            done.append(_compared(codes, active, k, key))
            break
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def _compared(codes: DataFrame, queries: DataFrame, k: int, key: str, per_block: int = 8192) -> DataFrame:
    """Queries that have no near code, against all codes in blocks."""
    blocks = max(1, -(-codes.count() // per_block))
    dealt = codes.withColumn("block", F.pmod(F.xxhash64("fp"), F.lit(blocks)).cast("int"))
    met = dealt.join(queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), "block")
    scored = met.select("query_id", F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))).cast("int").alias("score"), F.explode("keys").alias(key)).filter(F.col(key) != F.col("query_id"))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", key))).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", key, "score", F.lit(codes.count()).alias("probed"))
