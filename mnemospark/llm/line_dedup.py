"""Line deduplication by range-partitioned hashes with a secondary sort.

A line's key is the line stripped of white space at both ends, A-Z lower-cased.  Documents
send ``(hash of key, doc, line numbers)`` for keys long enough; rows are range-partitioned and
sorted by hash, then document from largest to smallest, and each partition is streamed once:
the first row of a hash is the document that keeps its lines, the others lose them if the key
is in enough documents.  Since ranges are cut by hash *and* document, a very common line is
spread over many partitions; runs that touch a partition's edge are decided afterwards from
one summary row per edge run.  What comes back are bitmaps of kept lines, not text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, bounded, documents_of, raw_texts, small_batches, written


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).lower()


def points(data: bytes) -> int:
    """Code points of UTF-8 bytes."""
    if data.isascii():
        return len(data)
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


KEYS = "hi long, lo long, doc_id long, sig long, lines binary"


def line_keys(docs: DataFrame, least_points: int = 40) -> DataFrame:
    """One row per document and distinct key: 128-bit hash and the numbers of its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            hashes, docs_, sigs, lines = [], [], [], []
            for doc_id, sig, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), raw_texts(batch.column(1)), strict=True):
                found: dict[bytes, list[int]] = {}
                for number, line in enumerate(raw.split(b"\n")):
                    if len(line) >= least_points:
                        key = line_key(line)
                        if len(key) >= least_points and points(key) >= least_points:
                            found.setdefault(xxhash.xxh3_128_digest(key), []).append(number)
                hashes += found
                lines += [np.array(x, "<u4").tobytes() for x in found.values()]
                docs_ += [doc_id] * len(found)
                sigs += [sig] * len(found)
            both = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(docs_, pa.int64()), pa.array(sigs, pa.int64()), pa.array(lines, pa.binary())],
                names=["hi", "lo", "doc_id", "sig", "lines"],
            )

    return documents_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "sig").mapInArrow(run, KEYS)


DECIDED = "hi long, lo long, doc_id long, sig long, lines binary, run_docs int, open boolean"


def _stream(least_documents: int):
    """Decide the runs of one sorted range, batch by batch.

    Emits the rows that lose their lines (``open`` false) and all rows of each batch's first and
    last run (``open`` true), whose key may go on in the next batch or range; ``run_docs`` is, on
    the first row of such a run in a batch, how many documents it adds there.  Equal (key,
    document) never straddle a range, so these numbers add up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            hi, lo = (batch.column(k).to_numpy() for k in (0, 1))
            ids, none = batch.column(2).fill_null(0).to_numpy(), batch.column(2).is_null().to_numpy(zero_copy_only=False)
            new_run = np.concatenate(([True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])))
            new_doc = new_run | np.concatenate(([True], (ids[1:] != ids[:-1]) | (none[1:] != none[:-1])))
            run_of, doc_of = np.cumsum(new_run) - 1, np.cumsum(new_doc)
            first_doc = doc_of == doc_of[new_run][run_of]  # of the run's largest document
            new_doc[0] = last != (hi[0], lo[0], ids[0], none[0])
            last = hi[-1], lo[-1], ids[-1], none[-1]
            docs_of_run = np.bincount(run_of, weights=new_doc).astype(np.int64)
            edge = (run_of == 0) | (run_of == run_of[-1])
            at = np.nonzero(edge | (~first_doc & (docs_of_run[run_of] >= least_documents)))[0]
            told = np.where(new_run & edge, docs_of_run[run_of], 0).astype(np.int32)
            columns = batch.take(pa.array(at)).columns
            yield pa.RecordBatch.from_arrays([*columns, pa.array(told[at]), pa.array(edge[at])], names=[*batch.schema.names, "run_docs", "open"])

    return run


def dropped_lines(docs: DataFrame, least_points: int = 40, least_documents: int = 5, rows_per_range: int = 200_000) -> DataFrame:
    """``doc_id``, ``sig``, ``drops``: per document that loses lines, their numbers as packed
    little-endian 32-bit arrays, one per key."""
    keys = written(line_keys(docs, least_points), "lines")
    ranges = -(-keys.count() // rows_per_range) or 1
    order = [F.col("hi"), F.col("lo"), F.col("doc_id").desc_nulls_last()]
    decided = written(keys.repartitionByRange(ranges, *order).sortWithinPartitions(*order, "sig").mapInArrow(_stream(least_documents), DECIDED), "decided", per_core=4)
    own = F.coalesce("doc_id", F.lit(-(1 << 63)))
    still = decided.filter("open")
    sums = still.groupBy("hi", "lo").agg(F.sum("run_docs").alias("n_docs"), F.max(own).alias("largest")).filter(F.col("n_docs") >= least_documents)
    sums = written(sums, "sums", small=True)  # apart from its join, whose hot keys can then be split
    late = still.join(sums, ["hi", "lo"]).filter(own != F.col("largest"))
    drops = decided.filter("not open").select("doc_id", "sig", "lines").union(late.select("doc_id", "sig", "lines"))
    return drops.groupBy("doc_id", "sig").agg(F.collect_set("lines").alias("drops"))


def keep_bitmaps(docs: DataFrame, least_points: int = 40, least_documents: int = 5, rows_per_range: int = 200_000) -> DataFrame:
    """Which lines of each document stay, as a compressed bitmap.

    Texts split at line feeds (null or empty: one empty line).  A key (see :func:`line_key`) of
    at least ``least_points`` code points found in at least ``least_documents`` documents loses
    all its lines except those in the largest ``doc_id`` that has it; all other lines stay.

    Returns per input row ``doc_id``, ``sig`` (hash of the text), ``n_lines``, ``n_dropped`` and
    ``keep``: zlib-compressed bits in line order, the first line in the lowest bit of the first
    byte.  Rows that repeat a ``doc_id`` count as one document; a null id is one document, the
    smallest.  An empty table gives no rows.
    """
    lines = documents_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "sig", (F.regexp_count("text", F.lit("\n")) + 1).cast("long").alias("n_lines"))
    drops = dropped_lines(docs, least_points, least_documents, rows_per_range).select(F.col("doc_id").alias("d_id"), F.col("sig").alias("d_sig"), "drops")
    joined = lines.join(drops, lines.doc_id.eqNullSafe(drops.d_id) & (lines.sig == drops.d_sig), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, maps = [], []
            for n, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                keep = np.ones(n, bool)
                keep[np.frombuffer(b"".join(parts or []), "<u4")] = False
                counts.append(n - int(keep.sum()))
                maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(maps, pa.binary())], names=["doc_id", "sig", "n_lines", "n_dropped", "keep"])

    return joined.select("doc_id", "sig", "n_lines", "drops").mapInArrow(run, "doc_id long, sig long, n_lines long, n_dropped long, keep binary")


def kept_lines(raw: bytes, keep: bytes) -> bytes:
    """The text that a bitmap leaves, joined by line feeds."""
    lines = raw.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little", count=len(lines))
    return b"\n".join(line for line, bit in zip(lines, bits.tolist(), strict=True) if bit)


def line_digests(docs: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_dropped``, ``kept_sha256`` of the text each bitmap leaves.

    Only bitmaps of documents that lose lines travel; while they are few enough they are
    broadcast to the scan and no text is shuffled.
    """
    maps = keep_bitmaps(docs, **options).filter("n_dropped > 0").select(F.col("doc_id").alias("m_id"), F.col("sig").alias("m_sig"), "n_dropped", "keep").distinct()
    maps = written(maps, "bitmaps", small=True)
    texts = documents_of(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    joined = texts.join(bounded(maps, weight=F.greatest(F.lit(1), F.octet_length("keep") / 64)), texts.doc_id.eqNullSafe(maps.m_id) & (texts.sig == maps.m_sig), "left")
    n_lines = (F.regexp_count("text", F.lit("\n")) + 1).cast("long").alias("n_lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            pairs = zip(raw_texts(batch.column(3)), batch.column(4).to_pylist(), strict=True)
            found = [hashlib.sha256(raw if keep is None else kept_lines(raw, keep)).hexdigest() for raw, keep in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    rows = joined.select("doc_id", n_lines, F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "text", "keep")
    return rows.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
