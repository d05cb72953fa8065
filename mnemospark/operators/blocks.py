"""Exact search of many queries over many rows, block by block.

Rows and queries are dealt to blocks by a hash; each pair of a block of rows and one of queries is
a group, whose scores are one product of matrices and of which only the best leave the task.  So
no side is held whole anywhere, and what is shuffled after a group is ``k`` rows a query.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS, QUERIES = 16_384, 8192
#: Scores that a task holds at once.
AT_ONCE = 1 << 20


def matrix(column: pa.Array) -> np.ndarray:
    """Lists as rows of doubles; null components, and what shorter lists lack, are zero."""
    sizes = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    flat = column.flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), -1)
    out = np.zeros((len(sizes), sizes.max(initial=0)))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices cut to the columns that both have."""
    d = min(a.shape[1], b.shape[1])
    return a[:, :d], b[:, :d]


def dealt(rows: DataFrame, queries: DataFrame, key: str, query: str = "query_id", per_rows: int = ROWS, per_queries: int = QUERIES, per: tuple[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``row_block`` and ``query_block``, each row under every block of queries and
    each query under every block of rows, in as many partitions as there are pairs of blocks,
    which are small in bytes and would else be put together.  ``per``: a column on which the sides
    meet and about how many values it has, so that blocks are of the rows of a value."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    column, values = ([per[0]], per[1]) if per else ([], 1)
    n, q = -(-rows.count() // values), -(-queries.count() // values)
    b = max(1, -(-q // per_queries))
    a = max(1, -(-n // per_rows), min(-(-4 * cores // (b * values)), n // 512))
    at = lambda c, blocks: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = rows.withColumn("row_block", at(key, a)).withColumn("query_block", every(b))
    right = queries.withColumn("query_block", at(query, b)).withColumn("row_block", every(a))
    tasks, on = min(a * b * values, 64 * cores), [*column, "row_block", "query_block"]
    return left.repartition(tasks, *on), right.repartition(tasks, *on)


def best_of(scores: Callable[[slice], np.ndarray], ids: np.ndarray, query_ids: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, ids and scores of each query's ``k`` rows of the highest scores to ``digits``
    places, its own id not included, ties to the smaller id.  ``ids`` are in rising order;
    ``scores(some)`` has a row for each of some queries."""
    n, found = len(ids), ([], [], [])
    for at in range(0, len(query_ids), step := max(1, AT_ONCE // max(n, 1))):
        some = slice(at, at + step)
        raw = scores(some)
        low = -np.round(raw, digits)
        low[(query_ids[some, None] == ids) | np.isnan(raw)] = np.inf
        if n > k:
            limit = np.partition(low, k - 1, axis=1)[:, k - 1 : k]
            q, r = np.nonzero((low <= limit) & (low < np.inf))
        else:
            q, r = np.nonzero(low < np.inf)
        order = np.lexsort((r, low[q, r], q))
        q, r = q[order], r[order]
        first = np.searchsorted(q, q)  # of the query's own rows
        keep = np.arange(len(q)) - first < k
        q, r = q[keep], r[keep]
        for part, value in zip(found, (query_ids[some][q], ids[r], raw[q, r]), strict=True):
            part.append(value)
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in found)


def top_k(left: DataFrame, right: DataFrame, on: list[str], score: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int, digits: int, key: str = "vec_id", query: str = "query_id") -> DataFrame:
    """``query``, ``rank``, ``key``, ``score`` of the ``k`` best rows by ``score(queries, rows)``, two
    matrices, rounded to ``digits`` places, ties to the smaller key.  ``left`` (``key``, ``x``) and
    ``right`` (``query``, ``q``) meet on the columns ``on``; ids are longs.  Null vectors take no part."""

    def meet(some: pa.Table, asked: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if some.num_rows and asked.num_rows:
            some = some.sort_by(key)
            x, q = alike(matrix(some.column("x").combine_chunks()), matrix(asked.column("q").combine_chunks()))
            found = best_of(lambda part: score(q[part], x), some.column(key).to_numpy(), asked.column(query).to_numpy(), k, digits)
        return pa.table({query: pa.array(found[0], pa.int64()), key: pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    rows = left.select(*on, F.col(key).cast("long").alias(key), "x").filter("x is not null")
    asked = right.select(*on, F.col(query).cast("long").alias(query), "q").filter("q is not null")
    best = rows.groupBy(*on).cogroup(asked.groupBy(*on)).applyInArrow(meet, f"`{query}` long, `{key}` long, score double")
    best = best.withColumn("score", F.round("score", digits))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.col("score").desc(), key))).filter(F.col("rank") <= k)


def nearest(rows: DataFrame, queries: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int, digits: int = 6, key: str = "vec_id", query: str = "query_id") -> DataFrame:
    """:func:`top_k` of all rows (``key``, ``x``) for all queries (``query``, ``q``)."""
    left, right = dealt(rows, queries, key, query)
    return top_k(left, right, ["row_block", "query_block"], score, k, digits, key, query)


def dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return q @ x.T


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero where a vector has no length."""
    length = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1))
    return np.where(length > 0, q @ x.T / np.where(length > 0, length, 1), 0.0)


def sign_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``(cos + 1) / 2`` of a query with signs; 0.5 for a zero query."""
    length = (np.sqrt((q * q).sum(axis=1)) * np.sqrt(q.shape[1]))[:, None]
    return np.where(length > 0, (q @ x.T / np.where(length > 0, length, 1) + 1) / 2, 0.5)


def shared_signs(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Share of signs that agree, exact."""
    return (q @ x.T + x.shape[1]) / (2 * x.shape[1])


def max_dots(rows: DataFrame, queries: DataFrame, key: str, row: str = "vec_id") -> DataFrame:
    """``query_id``, ``key``, ``score``: the best dot product of any row (``row``, ``key``, ``x``) of a
    key; a group leaves one for each of its queries and keys."""
    kinds, left, right = dict(rows.dtypes) | {"query_id": dict(queries.dtypes)["query_id"]}, *dealt(rows, queries, row)

    def meet(some: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"query_id": asked.column("query_id").slice(0, 0), key: some.column(key).slice(0, 0), "score": pa.array([], pa.float64())}
        if not (some.num_rows and asked.num_rows):
            return pa.table(out)
        code = some.column(key).combine_chunks().dictionary_encode(null_encoding="encode")
        at = code.indices.to_numpy()
        order = np.argsort(at, kind="stable")
        starts = np.flatnonzero(np.diff(at[order], prepend=-1))
        x, q = alike(matrix(some.column("x").combine_chunks())[order], matrix(asked.column("q").combine_chunks()))
        step = max(1, AT_ONCE // len(x))
        best = np.concatenate([np.maximum.reduceat(q[k : k + step] @ x.T, starts, axis=1) for k in range(0, len(q), step)])
        names = code.dictionary.take(pa.array(np.tile(at[order][starts], len(q))))
        return pa.table({"query_id": asked.column("query_id").take(pa.array(np.repeat(np.arange(len(q)), len(starts)))), key: names, "score": pa.array(best.ravel())})

    on = ["row_block", "query_block"]
    left, right = left.select(*on, key, "x").filter("x is not null"), right.select(*on, "query_id", "q").filter("q is not null")
    found = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(meet, f"query_id {kinds['query_id']}, `{key}` {kinds[key]}, score double")
    return found.groupBy("query_id", key).agg(F.max("score").alias("score"))
