"""Exact deduplication by composable polynomial fingerprints.

Texts are equal when identical after their white space is deleted.  The normalised bytes of a
document are cut into chunks; each chunk gets a polynomial hash on its own, and the hashes
combine by length-shifted arithmetic, ``H(ab) = H(a) + r**len(a) * H(b)`` modulo a Mersenne
prime, so chunks of a huge document can be hashed in any order or in parallel.  Documents with
the same fingerprints and length are then compared chunk by chunk with one member of their
group; where a member differs (a collision), that group is split by SHA-256 instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, bounded, documents_of, raw_texts, small_batches, written

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_566_083_941)


@dataclass(frozen=True)
class Polynomial:
    """Chunked polynomial hash of bytes; a smaller ``prime`` makes collisions for tests."""

    chunk: int = 1 << 16
    prime: int = PRIME
    bases: tuple[int, int] = BASES

    def powers(self) -> list[np.ndarray]:
        out = []
        for base in self.bases:
            row, value = np.empty(self.chunk, np.int64), 1
            for k in range(self.chunk):
                row[k] = value
                value = value * base % self.prime
            out.append(row)
        return out

    def of_chunk(self, data: bytes, powers: list[np.ndarray]) -> tuple[int, ...]:
        """Sum of ``(byte + 1) * base**position``: below 2**9 * 2**31 * 2**16, so it fits."""
        values = np.frombuffer(data, np.uint8).astype(np.int64) + 1
        return tuple(int(values @ row[: len(values)]) % self.prime for row in powers)

    def joined(self, left: tuple[int, ...], length: int, right: tuple[int, ...]) -> tuple[int, ...]:
        """Hash of ``a + b`` from the hashes of both and the length of ``a``."""
        return tuple((a + pow(r, length, self.prime) * b) % self.prime for a, b, r in zip(left, right, self.bases, strict=True))

    def of(self, data: bytes, powers: list[np.ndarray]) -> tuple[int, ...]:
        whole: tuple[int, ...] = (0,) * len(self.bases)
        for at in range(0, len(data), self.chunk):
            whole = self.joined(whole, at, self.of_chunk(data[at : at + self.chunk], powers))
        return whole


FINGERPRINTS = "doc_id long, sig long, row long, n_points long, n_bytes long, fp_a long, fp_b long, text_sha256 string"


def fingerprints(docs: DataFrame, poly: Polynomial = Polynomial()) -> DataFrame:
    """One row per document: a number of its own, code points of the text, bytes, fingerprints
    and SHA-256 of the normalised text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = poly.powers()
        for batch in small_batches(batches, "text"):
            points, sizes, a, b, sha = [], [], [], [], []
            for raw in raw_texts(batch.column(1)):
                data = raw.translate(None, WHITE)
                points.append(len(raw.decode("utf-8", "replace")))
                sizes.append(len(data))
                x, y = poly.of(data, powers)
                a.append(x)
                b.append(y)
                sha.append(hashlib.sha256(data).hexdigest())
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), long(points), long(sizes), long(a), long(b), pa.array(sha, pa.string())],
                names=["doc_id", "sig", "row", "n_points", "n_bytes", "fp_a", "fp_b", "text_sha256"],
            )

    rows = documents_of(docs).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(run, FINGERPRINTS)


def _chunks(rows: DataFrame, chunk: int) -> DataFrame:
    """Normalised texts as rows of chunks; a task holds one document at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            head = [batch.column(k).to_pylist() for k in range(6)]
            for k, raw in enumerate(raw_texts(batch.column(6))):
                data = raw.translate(None, WHITE)
                parts = [data[at : at + chunk] for at in range(0, len(data), chunk)]
                n = len(parts)
                if n:
                    kinds = [pa.int64()] * 5 + [pa.bool_()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[k]] * n, t) for x, t in zip(head, kinds, strict=True)] + [pa.array(range(n), pa.int32()), pa.array(parts, pa.binary())],
                        names=["doc_id", "sig", "fp_a", "fp_b", "n_bytes", "leads", "chunk_no", "chunk"],
                    )

    return rows.select("doc_id", "sig", "fp_a", "fp_b", "n_bytes", "leads", "text").mapInArrow(
        run, "doc_id long, sig long, fp_a long, fp_b long, n_bytes long, leads boolean, chunk_no int, chunk binary"
    )


GROUP = ("fp_a", "fp_b", "n_bytes")


def collisions(docs: DataFrame, prints: DataFrame, poly: Polynomial = Polynomial()) -> DataFrame:
    """Groups of equal fingerprints in which some text differs from the group's first one.

    Only texts of groups with two or more rows are cut into chunks; each is compared chunk by
    chunk with its group's leader.  While the names of those texts are few they are broadcast to
    the scan, and only chunks are shuffled.  The leaders' chunks are written apart, so a hot
    group is a skewed side between two exchanges, which adaptive execution splits.
    """
    many = (
        prints.groupBy(*GROUP)
        .agg(F.count("*").alias("rows"), F.min(F.struct("doc_id", "sig")).alias("lead"))
        .filter("rows > 1 and n_bytes > 0")
        .select(*GROUP, F.col("lead.doc_id").alias("lead_id"), F.col("lead.sig").alias("lead_sig"))
    )
    many = written(many, "many", small=True)
    members = prints.select("doc_id", "sig", *GROUP).join(many, list(GROUP)).withColumn("leads", F.col("doc_id").eqNullSafe(F.col("lead_id")) & (F.col("sig") == F.col("lead_sig")))
    members = written(members.select(F.col("doc_id").alias("m_id"), F.col("sig").alias("m_sig"), *GROUP, "leads").distinct(), "members", small=True)
    texts = documents_of(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    found = texts.join(bounded(members), texts.doc_id.eqNullSafe(members.m_id) & (texts.sig == members.m_sig))
    chunks = written(_chunks(found, poly.chunk), "chunks", narrow=True)
    lead = chunks.filter("leads").select(*GROUP, "chunk_no", F.col("chunk").alias("lead_chunk")).dropDuplicates([*GROUP, "chunk_no"])
    lead = written(lead, "leaders", small=True)
    pairs = chunks.filter("not leads").join(lead, [*GROUP, "chunk_no"], "left")
    return pairs.filter(~F.col("chunk").eqNullSafe(F.col("lead_chunk"))).select(*GROUP).distinct()


def exact_duplicates(docs: DataFrame, poly: Polynomial = Polynomial()) -> DataFrame:
    """Group documents whose texts are equal after white space is deleted.

    Returns one row per input row: ``doc_id``, ``keep_id`` (the row of the group with the most
    code points in its original text, then the smallest ``doc_id``, a null one last),
    ``group_size``, ``kept``, ``text_sha256`` of the normalised text, and ``sig`` (hash of the
    original text).

    Null and empty texts, and texts of white space only, form one group.  Rows that repeat a
    ``doc_id`` count separately in ``group_size``.  Exactly one row of a group is marked kept,
    also where rows repeat both id and text.  An empty table gives an empty result.
    """
    prints = written(fingerprints(docs, poly), "fingerprints", narrow=True)
    bad = written(collisions(docs, prints, poly), "collisions", files=1)
    rows = prints
    if bad.isEmpty():
        rows = rows.withColumn("part", F.lit(""))
    else:
        split = bad.withColumn("split", F.lit(True))
        rows = written(rows.join(split, list(GROUP), "left").withColumn("part", F.when(F.col("split"), F.col("text_sha256")).otherwise(F.lit(""))).drop("split"), "classes", per_core=4)
    best = F.min(F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    groups = rows.groupBy(*GROUP, "part").agg(F.count("*").alias("group_size"), best)
    out = rows.join(written(groups, "groups", small=True), [*GROUP, "part"])
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256", "sig")
