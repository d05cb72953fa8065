"""Clusters around centroids: Lloyd's rounds over distinct quantised vectors with multiplicities.

A vector's components become whole numbers, so equal vectors are frequent and sums are exact.
Equal vectors are grouped first; a round then reads each distinct vector once, and a task adds
its vectors, times their multiplicities, to one sum per cluster and component.  What leaves a
task is a row per cluster, whatever it has read, so neither a vector that a third of all rows
repeat nor a cluster that holds nearly all of them meets in one place.  The driver gets the
centroids only.  In the end the assignments of distinct vectors are joined back to the ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

LARGEST = (1 << 63) - 1
#: Components below this size have squared distances that doubles hold exactly up to 2**14 dimensions.
PLAIN = 1 << 18


def encoded(rows: np.ndarray) -> list[bytes]:
    """Each row of longs as bytes: the width in bytes that all its components fit in, then the
    components.  Equal rows, and no others, have equal bytes."""
    least, most = rows.min(axis=1, initial=0), rows.max(axis=1, initial=0)
    width = np.full(len(rows), 8)
    for w in (4, 2, 1):
        width[(least >= -(1 << (8 * w - 1))) & (most < 1 << (8 * w - 1))] = w
    out: list[bytes] = [b""] * len(rows)
    for w in (1, 2, 4, 8):
        for k, row in zip(np.flatnonzero(width == w), rows[width == w].astype(f"<i{w}"), strict=True):
            out[k] = bytes((w,)) + row.tobytes()
    return out


def decoded(codes: list[bytes], dims: int) -> np.ndarray:
    rows, widths = np.empty((len(codes), dims), np.int64), np.array([c[0] for c in codes], np.int64)
    for w in np.unique(widths):
        of = np.flatnonzero(widths == w)
        rows[of] = np.frombuffer(b"".join(codes[k][1:] for k in of), f"<i{w}").reshape(len(of), dims)
    return rows


def nearest(rows: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int]]:
    """The nearest centroid of each row, ties to the smaller number, and the squared distance;
    in doubles while they are exact, else in Python integers."""
    at, far = np.zeros(len(rows), np.int32), [0] * len(rows)
    large = max(abs(x) for c in centroids for x in c) >= PLAIN if centroids[0] else False
    plain = (rows > -PLAIN).all(axis=1) & (rows < PLAIN).all(axis=1) & (not large)
    if of := np.flatnonzero(plain).tolist():
        x, c = rows[of].astype(np.float64), np.array(centroids, np.float64)
        squares = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
        best = squares.argmin(axis=1)
        at[of] = best
        for k, d in zip(of, squares[np.arange(len(of)), best].tolist(), strict=True):
            far[k] = int(d)
    for k in np.flatnonzero(~plain):
        x = rows[k].tolist()
        far[k], at[k] = min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))
    return at, far


def weighted_sums(rows: np.ndarray, weights: np.ndarray, at: np.ndarray, clusters: int) -> tuple[np.ndarray, np.ndarray]:
    """Per cluster the sum of weights and of weighted rows, as Python integers."""
    order = np.argsort(at, kind="stable")
    found, starts = np.unique(at[order], return_index=True)
    largest = max(int(rows.max(initial=0)), -int(rows.min(initial=0)))
    whole = rows[order] if largest * int(weights.sum()) < 1 << 62 else rows[order].astype(object)
    counts, sums = np.zeros(clusters, object), np.zeros((clusters, rows.shape[1]), object)
    counts[found] = np.add.reduceat(weights[order], starts).tolist()
    sums[found] = np.add.reduceat(whole * weights[order].astype(whole.dtype)[:, None], starts).astype(object)
    return counts, sums


def quantised(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """``vec_id`` and ``code`` of every vector of ``dims`` finite components."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1)
            flat = np.asarray(x.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
            good = np.isfinite(flat).all(axis=1)
            with np.errstate(over="ignore"):
                whole = np.floor(flat[good] * scale)
            held = np.where(whole >= 2.0**63, LARGEST, np.where(whole < -(2.0**63), -LARGEST - 1, 0))
            rows = np.where((whole < 2.0**63) & (whole >= -(2.0**63)), np.where(held == 0, whole, 0).astype(np.int64), held)
            yield pa.record_batch({"vec_id": batch.column(0).filter(pa.array(good)), "code": pa.array(encoded(rows), pa.binary())})

    known = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    return known.filter((F.size("x") == dims) & ~F.exists("x", lambda v: v.isNull())).mapInArrow(encode, "vec_id long, code binary")


def _batches(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            codes = batch.column(0).to_pylist()
            yield codes, decoded(codes, dims), batch.column(1).to_numpy()


def _moved(distinct: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """The centroids after one round."""
    k = len(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, object), np.zeros((k, dims), object)
        for _, rows, weights in _batches(batches, dims):
            more = weighted_sums(rows, weights, nearest(rows, centroids)[0], k)
            counts, sums = counts + more[0], sums + more[1]
        some = [j for j in range(k) if counts[j]]
        values = [[Decimal(int(x)) for x in sums[j]] for j in some]
        yield pa.record_batch({"cluster": pa.array(some, pa.int32()), "n": pa.array([int(counts[j]) for j in some], pa.int64()), "sums": pa.array(values, pa.list_(pa.decimal128(38, 0)))})

    parts = distinct.mapInArrow(add, "cluster int, n long, sums array<decimal(38,0)>")
    totals = parts.groupBy("cluster").agg(F.sum("n"), *[F.sum(F.get("sums", F.lit(j))) for j in range(dims)]).collect()
    moved = {r[0]: [int(x) // int(r[1]) for x in r[2:]] for r in totals}
    return [moved.get(j, c) for j, c in enumerate(centroids)]


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1") -> DataFrame:
    """Assign every vector to one of ``k`` clusters.

    Components ``x`` become ``floor(scale * x)``.  The first centroids are the ``k`` vectors with
    the smallest hexadecimal SHA-256 of ``<seed>:<vec_id>``, in that order (of rows that repeat an
    id, the smaller code first).  Each of ``rounds`` rounds assigns vectors to the nearest centroid
    by squared Euclidean distance, ties to the smaller number, and moves every centroid that has
    vectors to the componentwise floor of their mean; all sums are exact.  Returns per vector
    ``vec_id``, ``cluster``, ``distance``, ``cluster_inertia`` and ``inertia`` (sums of distances over
    its cluster and over all), ``centroid_sha256`` (of its final centroid's components, joined by
    commas) and ``copies``, the rows with the same quantised vector.

    Vectors that are null, have another number of components, or hold a null or non-finite one
    give no row.  A vector with a null ``vec_id`` takes part but starts no centroid; rows that
    repeat an id, or id and vector, are vectors of their own.  Fewer than ``k`` vectors give fewer
    clusters, an empty table no rows.  Components, distances and their sums that a long cannot
    hold are held to its range.

    Vectors are kept as a byte a component where that holds them.  Equal vectors are counted
    with map-side combining; the join back to the ids has a stored table on either side, so
    adaptive execution splits a vector that many rows repeat.
    """
    spark = vectors.sparkSession
    points = written(quantised(vectors, dims, scale), "quantised", per_core=2)
    distinct = written(points.groupBy("code").agg(F.count("*").alias("copies")), "distinct", per_core=2)
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = points.filter(F.col("vec_id").isNotNull()).select(rank.alias("rank"), "code").orderBy("rank", "code").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, copies long")
    centroids = decoded([bytes(r.code) for r in first], dims).tolist()
    for _ in range(rounds):
        centroids = _moved(distinct, centroids, dims)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, rows, copies in _batches(batches, dims):
            at, far = nearest(rows, centroids)
            yield pa.record_batch({"code": pa.array(codes, pa.binary()), "cluster": pa.array(at, pa.int32()), "distance": pa.array([min(d, LARGEST) for d in far], pa.int64()), "copies": pa.array(copies, pa.int64())})

    assigned = written(distinct.mapInArrow(assign, "code binary, cluster int, distance long, copies long"), "assigned", per_core=2)
    inertia = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)") * F.col("copies")).alias("d")).collect()
    every = min(sum(int(r.d) for r in inertia), LARGEST)
    names = {j: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for j, c in enumerate(centroids)}
    told = [(r.cluster, min(int(r.d), LARGEST), every, names[r.cluster]) for r in inertia]
    clusters = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # at most k rows
    found = points.join(assigned, "code").join(F.broadcast(clusters), "cluster")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "copies")
