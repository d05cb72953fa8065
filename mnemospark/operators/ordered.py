"""Ordered work within keys of any size: positions, prefix composition, hash chains.

Rows are dealt by range of (key, order), so a key that holds a third of all rows lies in many
tasks one after the other; its parts are then joined by what a part says of itself: how many
rows it has, or how it maps the state before it to the state after it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written


def segmented(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The rows in order of key and ``order`` with ``segment``, the task a row is in; a key's
    segments follow each other by number."""
    ranged = rows.repartitionByRange(key, *order).withColumn("segment", F.spark_partition_id())
    return ranged.sortWithinPartitions(key, *order)


def positioned(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The rows with ``pos``, from 0 in the order of their key; rows that ``order`` leaves equal get
    any of their positions.

    No window holds more of a key than a task of the range does.  At most one key goes on from
    one segment into the next, so what is broadcast is a row per task at most.
    """
    dealt = written(segmented(rows, key, *order), "segments")
    counts = dealt.groupBy(F.col(key).alias("of"), F.col("segment").alias("at")).agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)))
    offsets = written(before.filter("before is not null").select("of", "at", "before"), "offsets", small=True)
    local = F.row_number().over(Window.partitionBy("segment", key).orderBy(*order)) - 1
    placed = dealt.withColumn("local", local).join(F.broadcast(offsets), F.col(key).eqNullSafe(F.col("of")) & (F.col("segment") == F.col("at")), "left")
    return placed.withColumn("pos", F.col("local") + F.coalesce("before", F.lit(0))).drop("local", "segment", "of", "at", "before")


def in_blocks(placed: DataFrame, reach: int, block: int = 100_000) -> DataFrame:
    """Positioned rows with ``block``, so that windows over (key, block) in order of ``pos`` that
    look back ``reach`` rows hold about ``block`` rows of however large a key.  The last ``reach``
    rows of a block are in the next one too, there with ``context``."""
    own = F.floor(F.col("pos") / block)
    late = F.col("pos") % block >= block - reach
    both = F.array(F.struct(own.alias("block"), F.lit(False).alias("context")), F.struct((own + 1).alias("block"), F.lit(True).alias("context")))
    one = F.array(F.struct(own.alias("block"), F.lit(False).alias("context")))
    return placed.select("*", F.explode(F.when(late, both).otherwise(one)).alias("b")).select("*", "b.block", "b.context").drop("b")


class Sums:
    """What a run of scores makes of each start of a sum that fires, and starts again at zero,
    once it has reached a threshold.  Starts that have come to the same sum stay together, so
    after about a threshold's worth of scores few are left to be kept apart."""

    def __init__(self, starts: int, threshold: int) -> None:
        self.threshold, self.rows = threshold, 0
        self.sums, self.fired = np.arange(starts), np.zeros(starts, np.int64)
        self.of, self.extra = np.arange(starts), np.zeros(starts, np.int64)

    def add(self, scores: list[int]) -> None:
        at = 0
        while at < len(scores) and len(self.sums) > 1:
            self.sums = self.sums + scores[at]
            over = self.sums >= self.threshold
            self.fired += over
            self.sums[over] = 0
            at += 1
            if over.sum() > 1:
                self._merge()
        total, fired = int(self.sums[0]), 0
        for x in scores[at:]:
            total += x
            if total >= self.threshold:
                total, fired = 0, fired + 1
        if at < len(scores):
            self.sums[0] = total
            self.fired[0] += fired

    def _merge(self) -> None:
        sums, first, to = np.unique(self.sums, return_index=True, return_inverse=True)
        self.extra += self.fired[self.of] - self.fired[first][to[self.of]]
        self.sums, self.fired, self.of = sums, self.fired[first], to[self.of]

    def table(self) -> tuple[list[int], list[int]]:
        return self.sums[self.of].tolist(), (self.extra + self.fired[self.of]).tolist()


def accumulated(rows: DataFrame, key: str, *order: str, threshold: int = 150) -> DataFrame:
    """``key``, ``fired`` and ``rest`` of a running sum of ``score`` in the key's order that fires
    and starts again at zero once it has reached ``threshold``.

    A segment of a key is a table from the ``threshold`` sums it may begin with to the sum and the
    firings it ends with; tables compose in order of the segments.  Only the first key of a task
    can have begun before it, so all others keep the row of the sum zero alone.  Scores are whole
    and not negative, a null one is 0; a null key is one of its own; no rows give no rows.
    """

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sums, kind, segment = None, None, None, 0

        def told() -> pa.RecordBatch:
            ends, fired = sums.table()
            return pa.record_batch({key: pa.array([current], kind), "segment": pa.array([segment], pa.int32()), "ends": pa.array([ends], pa.list_(pa.int64())), "fired": pa.array([fired], pa.list_(pa.int64()))})

        for batch in batches:
            if not batch.num_rows:
                continue
            kind, segment = batch.column(0).type, batch.column(2)[0].as_py()
            codes = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            scores = batch.column(1).fill_null(0).to_pylist()
            starts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            for a, b in zip(starts, starts[1:], strict=False):
                found = batch.column(0)[a].as_py()
                if sums is None:
                    current, sums = found, Sums(threshold, threshold)
                elif found != current:
                    yield told()
                    current, sums = found, Sums(1, threshold)
                sums.add(scores[a:b])
        if sums is not None:
            yield told()

    kind = dict(rows.dtypes)[key]
    dealt = segmented(rows.select(key, F.col("score").cast("long").alias("score"), *[F.col(c).alias(f"order_{k}") for k, c in enumerate(order)]), key, *[f"order_{k}" for k in range(len(order))])
    parts = dealt.select(key, "score", "segment").mapInArrow(tables, f"`{key}` {kind}, segment int, ends array<long>, fired array<long>")
    zero = F.struct(F.lit(0).cast("long").alias("rest"), F.lit(0).cast("long").alias("fired"))
    at = lambda acc, xs: F.element_at(xs, (acc["rest"] + 1).cast("int"))
    step = lambda acc, x: F.struct(at(acc, x["ends"]).alias("rest"), (acc["fired"] + at(acc, x["fired"])).alias("fired"))
    whole = parts.groupBy(key).agg(F.aggregate(F.array_sort(F.collect_list(F.struct("segment", "ends", "fired"))), zero, step).alias("s"))  # a row per key and task
    return whole.select(key, "s.fired", "s.rest")


def chained(rows: DataFrame, key: str, line: str, order: str) -> DataFrame:
    """``key``, ``order`` and ``hash``, the hexadecimal SHA-256 of the hash before, a bar and the
    row's ``line``.  Each hash needs the one before, so a chain is read in sequence; a task streams
    its sorted rows and carries one hash, whatever the length of the chain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, before = object(), ""
        for batch in batches:
            out = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != current:
                    current, before = k, ""
                before = hashlib.sha256(f"{before}|{text}".encode()).hexdigest()
                out.append(before)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=[key, order, "hash"])

    dealt = rows.select(key, F.col(order).cast("long").alias(order), line).repartition(key).sortWithinPartitions(key, order)
    return dealt.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, `{order}` long, hash string")
