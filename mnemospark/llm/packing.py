"""Packing documents into fixed sequences by the sum-of-squares rule.

Bins are described by their gap (what is still free).  A piece goes where the sum over all
gaps of the squared number of open bins with that gap becomes smallest; opening a new bin is
one of the choices.  Equal choices go to the smallest gap, as in best fit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, raw_texts, small_batches, written
from .tokens import VOCABULARY, encoder

NEVER = np.iinfo(np.int64).max
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, size: int = 1024, vocabulary: str = VOCABULARY, end_id: int = 2) -> DataFrame:
    """Each document's ids, followed by ``end_id``, cut into pieces of ``size`` if longer.

    The first piece takes the remainder, all later ones are full.  Null and empty texts give
    one piece that holds only the end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in small_batches(batches, "text"):
            rows: list[list] = [[], [], [], [], []]
            for doc_id, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                ids = np.array(encode(raw.decode("utf-8", "replace")) + [end_id], "<u4")
                at, end, piece = 0, len(ids) % size or size, 0
                while at < len(ids):
                    for values, value in zip(rows, (doc_id, piece, at, end - at, zlib.crc32(ids[at:end].tobytes())), strict=True):
                        values.append(value)
                    at, end, piece = end, end + size, piece + 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


class SumOfSquares:
    """Open bins by gap; :meth:`place` gives the bin and the offset of a piece."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.counts = np.zeros(size + 1, np.int64)  # open bins by gap; full ones are not counted
        self.open: list[list[int]] = [[] for _ in range(size + 1)]
        self.bins = 0

    def place(self, length: int, sparing: bool = True) -> tuple[int, int]:
        """Place one piece; ``sparing``: open a new bin only where no open bin can take it."""
        counts, size = self.counts, self.size
        change = 2 * (counts[: size + 1 - length] - counts[length:]) + 2
        change[0] = 1 - 2 * counts[length]  # a full bin leaves the sum
        change[counts[length:] == 0] = NEVER
        fresh = NEVER if sparing else 2 * counts[size - length] + 1
        best = int(change.argmin())
        if change[best] < fresh:
            gap = best + length
            number = self.open[gap].pop()
            counts[gap] -= 1
        else:
            gap, number = size, self.bins
            self.bins += 1
        left = gap - length
        if left:
            counts[left] += 1
            self.open[left].append(number)
        return number, size - gap


def placed(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """Bin and offset of each piece, in the order given.

    Two orders of arrival are tried and the one with fewer bins is kept: longest first and
    sparing with new bins; or the pieces over an eighth of a bin in a seeded order by the plain
    rule, which keeps all gaps in stock, and then the small ones, longest first.
    """
    descending = sorted(range(len(lengths)), key=lambda k: -lengths[k])
    large = [k for k in descending if lengths[k] * 8 > size]
    shuffled = [large[k] for k in np.random.default_rng(len(lengths)).permutation(len(large))]
    best: tuple[int, list] | None = None
    for plain, rest in ((shuffled, descending[len(large) :]), ([], descending)):
        bins, found = SumOfSquares(size), [(0, 0)] * len(lengths)
        for order, sparing in ((plain, False), (rest, True)):
            for k in order:
                found[k] = bins.place(lengths[k], sparing)
        if best is None or bins.bins < best[0]:
            best = bins.bins, found
    return best[1]


def packed(docs: DataFrame, size: int = 1024, vocabulary: str = VOCABULARY, end_id: int = 2, rows_per_task: int = 50_000) -> DataFrame:
    """Pack all documents into sequences of at most ``size`` tokens.

    Returns one row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id`` (any numbers) and ``offset``; within a sequence offsets have no gaps.  A
    full piece is a sequence of its own.  All shorter pieces are dealt to tasks of about
    ``rows_per_task``; each task packs its own by sum of squares, see :func:`placed`.  What that
    loses against one global packing is at most a few part-filled sequences a task.

    Rows that repeat an id are packed as documents of their own.  An empty table gives no rows.
    """
    cut = written(pieces(docs, size, vocabulary, end_id), "pieces", narrow=True)
    full = cut.filter(F.col("length") == size).select("*", (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = cut.filter(F.col("length") < size)
    tasks = -(-short.count() // rows_per_task) or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        part = TaskContext.get().partitionId()
        places = placed(table.column("length").to_pylist(), size)
        ids = pa.array([((part << 32) + number) * 2 + 1 for number, _ in places], pa.int64())
        table = table.append_column("sequence_id", ids).append_column("offset", pa.array([at for _, at in places], pa.int64()))
        yield from table.to_batches(max_chunksize=10_000)

    return full.unionByName(short.repartition(tasks).mapInArrow(run, PIECES + ", sequence_id long, offset long"))
