"""Exact top-k inner products by no-random-access aggregation.

Candidates are dealt to blocks, and a block to groups.  In a group every dimension is a list of
its candidates, sorted by component.  A query reads all lists in sequence, from the end that is
better for the sign of its weight, to the same depth; what it has read adds up per candidate.
The entries of a list that are still unread are no better than the last one read and no worse
than the list's other end, which bounds every candidate from both sides.  Candidates whose upper
bound does not reach the k-th largest lower bound, in which the groups read before have a part,
cannot qualify.  Reading stops when no more than a few can, or the lists end; the final scores
of those are resolved exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LARGEST = (1 << 63) - 1
EXACT = float(1 << 53)


def _exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products as longs: in doubles while exact, else in Python integers, held to the
    range of a long."""
    d = rows.shape[1]
    if d == 0 or not len(rows):
        return np.zeros(len(rows), np.int64)
    if np.abs(rows).max() * np.abs(query).max() * d < EXACT:
        return (rows @ query).astype(np.int64)
    q = [int(x) for x in query]
    return np.array([max(-LARGEST - 1, min(LARGEST, sum(int(a) * b for a, b in zip(row, q, strict=True)))) for row in rows], np.int64)


class Lists:
    """The sorted lists of a group of candidates, one per dimension: ``rank`` is a candidate's place
    in each, ``values`` has the lists' components from the best to the worst for a positive weight."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(-rows, axis=0, kind="stable")
        self.ids, self.rows, self.values = ids, rows, np.take_along_axis(rows, order, 0)
        self.rank = np.empty(rows.shape, np.int32)
        np.put_along_axis(self.rank, order, np.arange(len(rows), dtype=np.int32)[:, None], 0)

    def candidates(self, query_ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray, few: int = 32, looks: int = 8) -> tuple[np.ndarray, int]:
        """For some queries at once which candidates (rows) may be among the ``k`` best of each query
        (columns) of at least its score ``least``, and the entries read to tell.  ``few``: how many
        are left to be resolved when a query stops reading; ``looks``: how often bounds are
        compared on the way to the lists' ends.

        A query reads a list from the front if its weight is positive, from the back if it is
        negative; so what all queries read between two depths are two slabs of the lists.
        """
        n, d = self.rows.shape
        can = self.ids[:, None] != query_ids
        if not n or not d or float(np.abs(self.rows).max()) * float(np.abs(queries).max(initial=0)) * d > 1e290:  # no bounds beyond doubles
            return can, 0
        front, back = np.maximum(queries, 0).T, np.minimum(queries, 0).T
        worst_front, worst_back = front * self.values[-1][:, None], back * self.values[0][:, None]
        active, at, read = np.flatnonzero(can.sum(axis=0) > few), 0, 0
        seen = np.zeros((n, len(queries)))
        lower = np.tile(worst_front.sum(axis=0) + worst_back.sum(axis=0), (n, 1))
        while at < n and len(active):
            to = min(n, at + max(few, -(-n // looks)))
            ahead, behind = ((self.rank >= at) & (self.rank < to)).astype(float), ((self.rank < n - at) & (self.rank >= n - to)).astype(float)
            found = (ahead * self.rows) @ front[:, active] + (behind * self.rows) @ back[:, active]
            seen[:, active] += found
            lower[:, active] += found - ahead @ worst_front[:, active] - behind @ worst_back[:, active]
            read += (to - at) * int(np.count_nonzero(queries[active]))
            at = to
            last = front[:, active] * self.values[at - 1][:, None], back[:, active] * self.values[n - at][:, None]
            upper = seen[:, active] + (self.rank >= at) @ last[0] + (self.rank < n - at) @ last[1]
            floor = np.where(can[:, active], lower[:, active], -np.inf)
            limit = np.maximum(least[active], np.partition(floor, n - k, axis=0)[n - k]) if n >= k else least[active]
            slack = 0.5 + 1e-9 * np.abs(upper)  # scores are whole numbers; sums of large ones are rounded
            can[:, active] &= np.minimum(upper, LARGEST) + slack >= np.minimum(limit, LARGEST)
            active = active[can[:, active].sum(axis=0) > few]
        return can, read


def nra_top_k(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, group: int = 8192, at_once: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query ids, candidate ids and scores of each query's ``k`` best candidates of a block, and
    the number of list entries read."""
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
    read = 0
    for at in range(0, len(rows), group):
        lists = Lists(ids[at : at + group], rows[at : at + group])
        for first in range(0, len(queries), at_once):
            some = slice(first, first + at_once)
            least = np.array([float(x[-1]) if len(x) == k else -np.inf for x, _ in best[some]])
            can, n_read = lists.candidates(query_ids[some], queries[some], k, least)
            read += n_read
            for j, own in enumerate(can.T, first):
                best[j] = _merged(*best[j], _exact_scores(lists.rows[own], queries[j]), lists.ids[own], k)
    sizes = [len(x) for x, _ in best]
    out = [np.concatenate([x[m] for x in best]) if best else np.zeros(0, np.int64) for m in (1, 0)]
    return np.repeat(query_ids, sizes), out[0], out[1], read


def _merged(scores: np.ndarray, ids: np.ndarray, more: np.ndarray, their: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    scores, ids = np.concatenate((scores, more)), np.concatenate((ids, their))
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, block: int = 65_536, query_block: int = 8192) -> DataFrame:
    """For each query row the ``k`` candidates with the highest inner product.

    Components ``x`` become ``floor(256 * x)``.  Queries are the rows whose ``vec_id`` is
    divisible by ``every``, candidates all rows but the query's own.  Returns ``query_id``,
    ``rank`` from 1, ``vec_id`` and ``score``; ties go to the smaller ``vec_id``.

    Rows with a null ``vec_id``, and vectors that are null or hold a null or non-finite
    component, take no part.  Vectors meet those of the same length only.  Rows that repeat a
    ``vec_id`` are candidates of their own, but never for a query of that id; a repeated query
    row is asked once.  Scores beyond a long are held to its range.  Too few candidates give
    fewer rows, an empty table none.

    Blocks of about ``block`` candidates (32 MB at 64 dimensions) meet blocks of at most about
    ``query_block`` queries, of fewer where the cluster would have idle cores.  Both are dealt by
    a hash of the id, so equal vectors, however many, spread over all blocks.
    """
    x = F.col("embedding").cast("array<double>")
    valid = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # floor of a double is a long in Spark SQL; large values stay doubles, which are whole already
    whole = F.transform(x, lambda v: F.when(F.abs(v) < 2.0**52, F.floor(v * 256).cast("double")).otherwise(v * 256))
    rows = written(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(valid).select("vec_id", whole.alias("x"), F.size("embedding").alias("d")), "vectors")
    is_query = F.col("vec_id") % every == 0
    n, q = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    blocks = max(1, -(-n // block))
    spread = -(-2 * vectors.sparkSession.sparkContext.defaultParallelism // blocks)
    query_blocks = max(1, -(-q // query_block), min(spread, q // 64))
    hashed = F.xxhash64("vec_id")
    candidates = rows.withColumn("block", F.pmod(hashed, F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = rows.filter(is_query).dropDuplicates(["vec_id", "d"])
    queries = asked.withColumn("part", F.pmod(hashed, F.lit(query_blocks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            found = table.column("x").combine_chunks()
            return table.column("vec_id").to_numpy(), found.flatten().to_numpy().reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0))

        (ids, block_rows), (query_ids, asked_rows) = matrix(left), matrix(right)
        if len(ids) and len(query_ids):
            found = nra_top_k(ids, block_rows, query_ids, asked_rows, k)[:3]
        else:
            found = (np.zeros(0, np.int64),) * 3
        return pa.table({"query_id": found[0], "vec_id": found[1], "score": found[2]})

    key = ["d", "part", "block"]
    best = candidates.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
