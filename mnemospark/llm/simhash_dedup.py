"""SimHash near-duplicates found by multi-index hashing.

A 64-bit fingerprint is cut into two segments of 32 bits.  Of two fingerprints that differ in
at most two bits, one segment differs in at most one, so the pair is found if one side's
segment is looked up with every value of the Hamming ball of radius one around the other's.
Only flips from 0 to 1 are enumerated: of two segments one bit apart, one reaches the other
that way.  What a lookup fetches is verified on the complete distance.

A bucket of the table that holds many fingerprints (a large group of near copies agrees in one
segment) is not paired.  Its rows are indexed once more by the other segment: members and
probes meet in codes no further from either than one flip, each such code has at most 66 rows,
and a star of them keeps all links connected.  Both ways are exact; no candidate is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents_of, raw_texts, small_batches, written
from ..operators.components import components

SEED = 42
HALF = (1 << 32) - 1


def simhash_of(hashes: np.ndarray) -> int:
    """Majority of hashes, bit by bit: a bit is set if it is in over half of them."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words joined by a space; of the whole sequence if it is
    shorter, of nothing if there are no words."""
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends))[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def simhash(words: list[bytes], shingle: int) -> int:
    """Fingerprint of a word sequence, zero for none."""
    return simhash_of(shingle_hashes(words, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id``, ``sig``, ``fp`` (the fingerprint's bits as a signed long) of whole texts:
    A-Z lower-cased, words by white space, shingles of ``shingle`` words with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found = np.array([simhash(raw.lower().split(), shingle) for raw in raw_texts(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found.view(np.int64))], names=["doc_id", "sig", "fp"])

    return documents_of(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, sig long, fp long")


def _segment(number: int, fp: str = "fp") -> Column:
    return (F.col(fp) if number == 0 else F.shiftrightunsigned(F.col(fp), 32)).bitwiseAND(F.lit(HALF))


def _flips(value: Column, only_zeros: bool) -> Column:
    """The Hamming ball of radius one around a 32-bit value: itself and one flip each."""
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << k).cast("long") for k in range(32)])
    if only_zeros:
        masks = F.filter(masks, lambda m: value.bitwiseAND(m) == 0)
    return F.transform(masks, lambda m: value.bitwiseXOR(m))


def _index(prints: DataFrame, ball: bool) -> DataFrame:
    """Rows ``seg``, ``value``, ``fp``: each fingerprint under its two segments, or under their
    balls."""
    parts = []
    for number in (0, 1):
        own = _segment(number)
        value = F.explode(_flips(own, True)) if ball else own
        parts.append(prints.select(F.lit(number).alias("seg"), value.alias("value"), "fp"))
    return parts[0].union(parts[1])


def links(prints: DataFrame, bucket: int = 16) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints at most two bits apart.

    All pairs of ordinary buckets; for buckets of over ``bucket`` rows enough links to keep
    connected what is connected.

    Every join is hinted to sort and merge: what grows with the texts is small as a file, so that
    Spark would broadcast it, and many times larger once hashed on the driver.
    """
    table = _index(prints, False)
    crowded = written(table.groupBy("seg", "value").count().filter(F.col("count") > bucket).select("seg", "value"), "crowded", small=True)
    ordinary = table.join(crowded.hint("merge"), ["seg", "value"], "left_anti").withColumnRenamed("fp", "found")
    marked = crowded.withColumn("found", F.lit(None).cast("long"))
    met = written(_index(prints, True).join(ordinary.union(marked).hint("merge"), ["seg", "value"]), "met", per_core=4)
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("found"))) <= 2
    pairs = met.filter(F.col("found").isNotNull() & (F.col("fp") != F.col("found")) & near).select(F.col("fp").alias("a"), F.col("found").alias("b"))
    # crowded buckets: members are in them by their own value (no flip), probes by at most one
    hits = met.filter("found is null").select("seg", "value", "fp")
    own = F.when(F.col("seg") == 0, _segment(0)).otherwise(_segment(1))
    other = F.when(F.col("seg") == 0, _segment(1)).otherwise(_segment(0))
    codes = F.when(own == F.col("value"), _flips(other, False)).otherwise(F.array(other))
    meet = hits.select("seg", "value", "fp", F.explode(codes).alias("code"))
    least = meet.groupBy("seg", "value", "code").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low <> high").select("seg", "value", "code", "low")
    stars = meet.join(least.hint("merge"), ["seg", "value", "code"]).filter("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b")).distinct()
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, shingle: int = 3, bucket: int = 16) -> DataFrame:
    """Fingerprint every whole text and give each document its component.

    Fingerprints link at two or fewer differing bits; ``component_id`` is the smallest
    ``doc_id`` reachable, itself included.  Returns per input row ``doc_id``, ``fingerprint``
    (16 hex digits), ``component_id`` and ``sig`` (hash of the text).

    Null, empty and white-space texts have fingerprint zero, which links like any other.  Texts
    of fewer words than a shingle have one shingle, the whole sequence.  Exact copies share
    one fingerprint and never meet in pairs.  A null ``doc_id`` gives no name to a component
    unless all its ids are null.  An empty table gives no rows.
    """
    prints = written(fingerprints(docs, shingle), "fingerprints", narrow=True)
    distinct = written(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig")).alias("least")), "distinct", per_core=4)
    nodes = components(links(distinct.select("fp"), bucket))
    rooted = written(distinct.join(nodes.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted", small=True)
    names = written(rooted.groupBy("root").agg(F.min("least").alias("lead")), "names", small=True)  # apart from its join: a giant component can then be split
    named = rooted.select("fp", "root").join(names.hint("merge"), "root").select("fp", "lead")
    leads = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("sig") == F.col("lead.sig"))
    return prints.join(named.hint("merge"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("lead.doc_id").alias("component_id"), "sig", leads.alias("leads"))
