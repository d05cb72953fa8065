"""Near copies by word-shingle similarity, found with wide SimHash fingerprints.

A 64-bit fingerprint at two differing bits finds only the nearest copies: texts whose five-word
shingles have a Jaccard similarity of 0.8 differ in seven to ten bits.  Here a fingerprint is
as wide as the number of documents asks for, and is cut into segments of ``log2(n) - 2`` bits,
so that a segment's bucket holds a few texts by chance.
It is taken over the set of those five-word shingles, so that the similarity alone bounds the
share of bits that differ, whether words, a paragraph or the end of a text were changed.
Texts that agree in one segment (the Hamming ball of radius zero: for one recall, balls of
radius one over fewer segments take three times the index rows) are candidates, are verified
on the distance of an independent 128-bit fingerprint, which no unrelated texts pass, and are
then compared exactly.

A bucket of over ``bucket`` texts is first compared with a leader, the same one for most
buckets of a group, so most groups of near copies cost a few comparisons a text.  A crowded
bucket that these links leave in several components is then settled exactly: each of its texts
is compared with all texts of other components, those first whose shingles most others have, so
the original of a large group links its variants before they meet each other.  Large buckets
are dealt as pairs of blocks.  Which links exist is always decided by the exact similarity.

Joins are hinted to sort and merge, or counted first: files of fingerprints and shingles are small
enough for Spark to broadcast them, and many times larger once hashed on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, documents_of, raw_texts, small_batches, written
from ..operators.components import components
from .simhash_dedup import links, shingle_hashes, simhash_of

BITS = np.array([[(v >> k) & 1 for k in range(8)] for v in range(256)], np.int64)


def bit_rate(similarity: float) -> float:
    """Largest share of bits in which SimHashes of two sets of this Jaccard similarity differ:
    their cosine is least when they are of one size."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


@dataclass(frozen=True)
class Layout:
    """Segments of a wide fingerprint for a number of documents."""

    bits: int
    segments: int

    @staticmethod
    def of(n: int, similarity: float = 0.8, missed: float = 0.02) -> Layout:
        """``missed``: share of pairs of this similarity without a common segment, at most."""
        bits = max(10, math.ceil(math.log2(max(n, 2))) - 2)
        return Layout(bits, math.ceil(math.log(missed) / math.log(1 - (1 - bit_rate(similarity)) ** bits)))

    @property
    def words(self) -> int:
        return -(-self.bits * self.segments // 64)


def wide_simhash(hashes: np.ndarray, words: int) -> bytes:
    """A fingerprint of ``words`` times 64 bits: each word is the SimHash of the hashes mixed
    with another constant."""
    salts = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.zeros((words, 8, 8), np.int64)
    offsets = (np.arange(words)[:, None, None] * 8 + np.arange(8)[None, None, :]) * 256
    for at in range(0, len(hashes), 1024):  # bounded memory for very long texts
        x = hashes[None, at : at + 1024] ^ salts[:, None]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        places = x.view(np.uint8).reshape(words, -1, 8) + offsets
        counts += np.bincount(places.ravel(), minlength=words * 2048).reshape(words, 8, 256) @ BITS
    return np.packbits(counts.reshape(-1) * 2 > len(hashes), bitorder="little").tobytes()


def signatures(docs: DataFrame, words: int, shingle: int) -> DataFrame:
    """``doc_id``, ``sig``, ``fp`` (64 bits of three-word shingles), ``wide``, ``own`` and ``own2`` (64
    bits more each) of the set of ``shingle``-word shingles, ``node``: texts with equal fingerprints are one
    node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            fps, wides = [], []
            for raw in raw_texts(batch.column(1)):
                split = raw.lower().split()
                fps.append(simhash_of(shingle_hashes(split, 3)))
                wides.append(wide_simhash(np.unique(shingle_hashes(split, shingle)), words + 2))
            fp = pa.array(np.array(fps, np.uint64).view(np.int64))
            node = np.array([xxhash.xxh3_64_intdigest(w, f) for w, f in zip(wides, fps, strict=True)], np.uint64).view(np.int64)
            own = np.frombuffer(b"".join(w[-16:] for w in wides), np.int64).reshape(-1, 2)
            wide = pa.array([w[:-16] for w in wides], pa.binary())
            columns = [batch.column(0), batch.column(2), fp, wide, *(pa.array(np.ascontiguousarray(own[:, k])) for k in (0, 1)), pa.array(node)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "sig", "fp", "wide", "own", "own2", "node"])

    return documents_of(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, sig long, fp long, wide binary, own long, own2 long, node long")


def index_rows(nodes: DataFrame, layout: Layout) -> DataFrame:
    """``key``, ``node``, ``fp``, ``fp2``: every node under each of its segments; the key is the
    number of the segment and its value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(layout.bits, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n = part.num_rows
                raw = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(n, -1)
                bits = np.unpackbits(raw, axis=1, bitorder="little")[:, : layout.bits * layout.segments]
                keys = bits.reshape(n, layout.segments, layout.bits) @ powers + (np.arange(layout.segments, dtype=np.int64) << layout.bits)
                repeat = lambda k: pa.array(np.repeat(part.column(k).to_numpy(), layout.segments))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), repeat(0), repeat(1), repeat(2)], names=["key", "node", "fp", "fp2"])

    return nodes.select("node", "fp", "fp2", "wide").mapInArrow(run, "key long, node long, fp long, fp2 long")


def candidates(index: DataFrame, bucket: int = 16, most_bits: int = 34) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a`` < ``b`` of nodes with a common segment whose 128-bit fingerprints differ in at
    most ``most_bits`` (at a rate of 15.1 % they differ in 19.3, a deviation of 4.1), of crowded
    buckets those with a leader; and the rows of crowded buckets, those of over ``bucket`` nodes."""
    crowds = written(index.groupBy("key").count().filter(F.col("count") > bucket).select("key"), "crowds", per_core=4)
    apart = lambda x, y, k: F.bit_count(x[k].bitwiseXOR(y[k]))
    near = lambda x, y: apart(x, y, "fp") + apart(x, y, "fp2") <= most_bits
    entry = F.struct("node", "fp", "fp2")
    lists = index.join(bounded(crowds), "key", "left_anti").groupBy("key").agg(F.collect_list(entry).alias("e")).filter(F.size("e") > 1)
    left = lists.select("e", F.explode("e").alias("x"))
    pairs = left.select("x", F.explode(F.filter("e", lambda y: (y["node"] > F.col("x.node")) & near(y, F.col("x")))).alias("y"))
    ordinary = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    crowded = written(index.join(bounded(crowds), "key", "left_semi"), "crowded", per_core=4)
    leaders = crowded.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node", "fp", "fp2")).alias("l"))
    leaders = written(leaders, "leaders", small=True)
    led = crowded.join(leaders.hint("merge"), "key").withColumn("n", entry).filter((F.col("node") != F.col("l.node")) & near(F.col("n"), F.col("l")))
    return ordinary.union(led.select(F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b"))), crowded


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``node``, ``s``: distinct shingle hashes of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            sets = [np.unique(shingle_hashes(raw.lower().split(), shingle)).view(np.int64) for raw in raw_texts(batch.column(1))]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["node", "s"])

    return texts.select("node", "text").mapInArrow(run, "node long, s array<long>")


def _jaccard(pairs: DataFrame, similarity: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for k in (2, 3):
                ends = np.concatenate(([0], np.cumsum(batch.column(k).value_lengths().to_numpy())))
                flat = batch.column(k).flatten().to_numpy()
                sets.append([flat[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)])
            keep = []
            for x, y in zip(*sets, strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return pairs.select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def connecting(sets: list[np.ndarray], labels: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between sets of distinct hashes at least ``similarity`` alike that connect what all
    such links and equal ``labels`` connect; sets of one component are not compared."""
    labels, sizes = labels.copy(), np.array([len(s) for s in sets])
    held, shingles, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owners = np.repeat(np.arange(len(sets)), sizes)
    spread = np.bincount(owners, weights=counts[shingles], minlength=len(sets)) / np.maximum(sizes, 1)
    common = counts[shingles] > 1
    shingles, owners = shingles[common], owners[common]
    ends = np.cumsum(np.bincount(owners, minlength=len(sets)))
    starts = ends - np.bincount(owners, minlength=len(sets))
    mark, waiting, found = np.zeros(len(held), bool), np.ones(len(sets), bool), []
    for x in np.argsort(-spread, kind="stable"):
        waiting[x] = False
        if (labels == labels[x]).all():
            break
        others = waiting & (labels != labels[x]) & (np.minimum(sizes, sizes[x]) >= similarity * np.maximum(sizes, sizes[x]))
        if not others.any():
            continue
        mine = shingles[starts[x] : ends[x]]
        mark[mine] = True
        shared = np.bincount(owners[mark[shingles]], minlength=len(sets))
        mark[mine] = False
        linked = np.flatnonzero(others & (shared >= similarity * (sizes + sizes[x] - shared)))
        for y in linked[np.unique(labels[linked], return_index=True)[1]]:
            found.append((int(x), int(y)))
        labels[np.isin(labels, labels[linked])] = labels[x]
    return found


def crowded_links(crowded: DataFrame, sets: DataFrame, roots: DataFrame, similarity: float, block: int = 1 << 20) -> DataFrame:
    """Links ``a``, ``b`` that connect what the similarity connects within each crowded bucket
    and ``roots`` (``node``, ``root``) does not.  A bucket of over ``block`` shingles is cut into
    blocks; each pair of blocks is a group of its own."""
    rooted = crowded.select("key", "node").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = written(rooted.join(sets.select("node", F.size("s").alias("n")).hint("merge"), "node"), "crowded", per_core=4)
    apart = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum("n").alias("total")).filter("low <> high")
    apart = written(apart.select("key", F.ceil(F.greatest(F.col("total"), F.lit(1)) / block).cast("int").alias("blocks")), "apart", small=True)
    rows = rooted.join(apart.hint("merge"), "key").withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    meets = F.explode(F.filter(every, lambda k: (k != F.col("own")) | (F.col("blocks") == 1)))
    rows = rows.withColumn("met", meets).select("key", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"), "node", "root")

    def run(table: pa.Table) -> pa.Table:
        node, (root, s) = table.column("node").to_numpy(), (table.column(k).combine_chunks() for k in ("root", "s"))
        ends = np.concatenate(([0], np.cumsum(s.value_lengths().to_numpy())))
        flat = s.flatten().to_numpy()
        found = connecting([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], root.to_numpy(), similarity)
        ends = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(node[ends[:, 0]], pa.int64()), "b": pa.array(node[ends[:, 1]], pa.int64())})

    return rows.join(sets.hint("merge"), "node").groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _two_bit_pairs(nodes: DataFrame, bucket: int) -> DataFrame:
    """Pairs of nodes whose 64-bit fingerprints of three-word shingles are two bits apart at most,
    by multi-index hashing; one node stands for each fingerprint."""
    first = written(nodes.groupBy("fp3").agg(F.min("node").alias("low")), "first", small=True)
    near = links(first.select(F.col("fp3").alias("fp")), bucket)
    of = lambda end, name: first.select(F.col("fp3").alias(end), F.col("low").alias(name))
    near = near.join(of("a", "na").hint("merge"), "a").join(of("b", "nb").hint("merge"), "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
    same = nodes.select("fp3", "node").join(first.hint("merge"), "fp3").filter("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    return near.union(same)


def similar_links(docs: DataFrame, rows: DataFrame, layout: Layout, similarity: float, shingle: int, bucket: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links ``a``, ``b`` between nodes whose texts are at least ``similarity`` alike, without
    those of crowded buckets that no leader has; rows of crowded buckets; shingles of nodes."""
    nodes = written(rows.groupBy("node").agg(F.first("own").alias("fp"), F.first("own2").alias("fp2"), F.first("wide").alias("wide"), F.first("fp").alias("fp3"), F.min(F.struct("doc_id", "sig")).alias("one")), "nodes", per_core=4)
    pairs, crowded = candidates(index_rows(nodes, layout), bucket)
    pairs = written(pairs.union(_two_bit_pairs(nodes, bucket)).distinct(), "pairs", per_core=4)
    met = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowded.select("node")).distinct()
    one = nodes.join(met.hint("merge"), "node").select("node", F.col("one.doc_id").alias("o_id"), F.col("one.sig").alias("o_sig"))
    one = written(one, "one", small=True)
    texts = documents_of(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    found = texts.join(bounded(one), texts.doc_id.eqNullSafe(one.o_id) & (texts.sig == one.o_sig))
    sets = written(shingle_sets(found, shingle).dropDuplicates(["node"]), "shingles", per_core=4)
    both = pairs.join(sets.withColumnRenamed("node", "a").hint("merge"), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("t")).hint("merge"), "b")
    return _jaccard(both, similarity), crowded, sets


def _lifted(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Links between nodes as links between the components they are in."""
    out = links
    for end in ("a", "b"):
        of = roots.select(F.col("node").alias(end), F.col("root").alias("to"))
        out = out.join(of.hint("merge"), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return out.select("a", "b")


def similar_documents(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, bucket: int = 16) -> DataFrame:
    """Groups of near copies: texts linked by a Jaccard similarity of at least ``similarity`` on
    the sets of their ``shingle``-word shingles.

    Every link is verified by the exact similarity.  Candidates are texts with a common segment
    of their wide fingerprints, which at most 2 % of the pairs at ``similarity`` miss, fewer
    above it; all texts of a crowded segment; and texts within two bits on 64-bit fingerprints
    of three-word shingles.

    Returns per input row ``doc_id``, ``sig`` (hash of the text), ``root`` (its group) and
    ``leads``: whether it is the row of its group to keep, the one with the smallest id, null
    last, then the smallest hash.  Null, empty and white-space texts are one group.  An empty
    table gives no rows.
    """
    layout = Layout.of(docs.count(), similarity)
    rows = written(signatures(docs, layout.words, shingle), "signatures", narrow=True)
    verified, crowded, sets = similar_links(docs, rows, layout, similarity, shingle, bucket)
    known = written(verified, "links", small=True)
    roots = written(components(known), "roots", small=True)
    # what crowded buckets add links whole components, so only their roots meet again
    more = written(crowded_links(crowded, sets, roots, similarity), "more", small=True)
    over = written(components(_lifted(more, roots)).withColumnRenamed("node", "low").withColumnRenamed("root", "over"), "over", small=True)
    rooted = rows.select("doc_id", "sig", "node").join(roots.hint("merge"), "node", "left").withColumn("low", F.coalesce("root", "node")).drop("root")
    rooted = rooted.join(over.hint("merge"), "low", "left").select("doc_id", "sig", F.coalesce("over", "low").alias("root"))
    rooted = written(rooted, "rooted", per_core=4)
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig")).alias("lead"))
    best = written(best, "best", small=True)
    out = rooted.join(best.hint("merge"), "root")
    return out.select("doc_id", "sig", "root", (F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("sig") == F.col("lead.sig"))).alias("leads"))
