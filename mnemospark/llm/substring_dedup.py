"""Substring deduplication by seed and extend.

Documents are word sequences.  Every window of ``window`` words contains an anchor: the
``seed``-word gram with the smallest hash among those in the window (the first, if equal).
Equal windows choose equal anchors at the same offset, so documents joined on anchors meet
wherever they share a window.  Consecutive windows with one anchor form a run; extending an
anchor both ways over its run gives the stretch of words it stands for.

* Anchors found once in the corpus have no partner and end here.
* Runs that are equal as a whole, anchor and both extensions, are repeats in all their windows.
* Runs that share an anchor but differ further out are extended window by window: each window
  is compared by a 128-bit hash with those of one example of every different run.

Windows that repeat join to maximal repeats.  A passage shared by very many documents is never
paired: its runs are counted, and only the different runs at its two ends are extended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, documents_of, raw_texts, small_batches, written

#: Odd multipliers of the rolling hashes, modulo 2**64, and their inverses.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Two rolling hashes over the words of a batch of documents.

    The words of all documents of a batch are one array; ``starts`` has each document's first
    word.  A word's two hashes come from XXH3-128, computed once per distinct word.
    """

    def __init__(self, texts: list[bytes]) -> None:
        words = [raw.split() for raw in texts]
        self.sizes = np.array([len(x) for x in words], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        column = pa.array([w for x in words for w in x], pa.binary()).dictionary_encode()
        table = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in column.dictionary.to_pylist()), "<u8").astype(np.uint64).reshape(-1, 2)
        codes = column.indices.to_numpy()
        n = len(codes)
        self.sums, self.powers = [], []
        for k in (0, 1):
            power, inverse = np.full(n, BASES[k], np.uint64), np.full(n + 1, INVERSES[k], np.uint64)
            if n:
                power[0] = 1
            inverse[0] = 1
            power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
            values = table[codes, k] * power if n else np.zeros(0, np.uint64)
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64))))
            self.powers.append(inverse)

    def of(self, first: np.ndarray, after: np.ndarray, kind: int) -> np.ndarray:
        """Hash of the words from ``first`` up to ``after``, wherever they stand."""
        return _mixed((self.sums[kind][after] - self.sums[kind][first]) * self.powers[kind][first] + (after - first).astype(np.uint64))


def runs_of(hashes: Hashes, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Runs of windows by anchor: document number, first window, number of windows, anchor hash
    and hash of the run's whole stretch with the anchor's place in it."""
    grams = len(hashes.sums[0]) - seed
    reach = window - seed + 1  # grams in a window
    if grams < reach:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    at = np.arange(grams)
    gram = hashes.of(at, at + seed, 0)
    # smallest gram of each window, the first if equal, by doubling
    best, span = at, 1
    while span < reach:
        step = min(span, reach - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(gram[right] < gram[left], right, left)
        span += step
    # windows that lie in one document
    document = np.repeat(np.arange(len(hashes.sizes)), np.maximum(hashes.sizes - window + 1, 0))
    local = np.arange(len(document)) - np.repeat(np.cumsum(np.maximum(hashes.sizes - window + 1, 0)) - np.maximum(hashes.sizes - window + 1, 0), np.maximum(hashes.sizes - window + 1, 0))
    place = hashes.starts[document] + local
    anchor = best[place]
    if not len(anchor):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (document[1:] != document[:-1])))
    first = np.nonzero(new)[0]
    count = np.diff(np.concatenate((first, [len(anchor)])))
    start = place[first]
    stretch = _mixed(hashes.of(start, start + count + window - 1, 1) + (anchor[first] - start).astype(np.uint64))
    return document[first], local[first], count, gram[anchor[first]], stretch


RUNS = "doc_id long, sig long, anchor long, stretch long, first int, n int"


def runs(docs: DataFrame, window: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            document, first, count, anchor, stretch = runs_of(Hashes(list(raw_texts(batch.column(1)))), window, seed)
            at = pa.array(document)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(2).take(at), pa.array(anchor.view(np.int64)), pa.array(stretch.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))],
                names=["doc_id", "sig", "anchor", "stretch", "first", "n"],
            )

    return _texts(docs).mapInArrow(run, RUNS)


def _texts(docs: DataFrame) -> DataFrame:
    return documents_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "sig")


def _windows(found: DataFrame, window: int) -> DataFrame:
    """Every window of the runs to extend: its 128-bit hash, document and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            hashes = Hashes(list(raw_texts(batch.column(1))))
            spans = batch.column(3)
            first, n = (spans.flatten().field(k).to_numpy().astype(np.int64) for k in ("first", "n"))
            document = np.repeat(np.repeat(np.arange(batch.num_rows), spans.value_lengths().to_numpy()), n)
            place = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            start = hashes.starts[document] + place
            at = pa.array(document)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(2).take(at), pa.array(place.astype(np.int32)), *(pa.array(hashes.of(start, start + window, k).view(np.int64)) for k in (0, 1))],
                names=["doc_id", "sig", "first", "w_a", "w_b"],
            )

    return found.select("doc_id", "text", "sig", "spans").mapInArrow(run, "doc_id long, sig long, first int, w_a long, w_b long")


def repeats(docs: DataFrame, window: int = 35, seed: int = 12) -> DataFrame:
    """Stretches of repeated windows: ``doc_id``, ``sig``, ``first`` window, ``n`` windows."""
    all_runs = written(runs(docs, window, seed), "runs")
    by_anchor = all_runs.groupBy("anchor").agg(F.count("*").alias("rows"), (F.min("stretch") != F.max("stretch")).alias("differ")).filter("rows > 1").select("anchor", "differ")
    by_anchor = written(by_anchor, "anchors", per_core=4)  # apart from its join, whose hot keys can then be split
    met = written(all_runs.join(by_anchor, "anchor"), "met", per_core=4)
    whole = met.groupBy("anchor", "stretch").agg(F.count("*").alias("rows"), F.min(F.struct("doc_id", "sig", "first", "n")).alias("example"), F.first("differ").alias("differ"))
    whole = written(whole, "whole", per_core=4)
    equal = met.select("doc_id", "sig", "anchor", "stretch", "first", "n").join(whole.filter("rows > 1").select("anchor", "stretch"), ["anchor", "stretch"], "left_semi").select("doc_id", "sig", "first", "n")
    extend = whole.filter("differ").select("example.*").groupBy(F.col("doc_id").alias("e_id"), F.col("sig").alias("e_sig")).agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    extend = written(extend, "extend", small=True)
    texts = _texts(docs)
    found = texts.join(bounded(extend, weight=1 + F.size("spans")), texts.doc_id.eqNullSafe(extend.e_id) & (texts.sig == extend.e_sig))
    # an example stands for one row, also where rows repeat both id and text
    windows = written(_windows(found, window).distinct(), "windows")
    twice = windows.groupBy("w_a", "w_b").count().filter("count > 1").select("w_a", "w_b")
    single = windows.join(twice, ["w_a", "w_b"], "left_semi").select("doc_id", "sig", "first", F.lit(1).alias("n"))
    return equal.union(single)


def removed_words(docs: DataFrame, window: int = 35, seed: int = 12) -> DataFrame:
    """Per document the texts and ``spans`` of its maximal repeats in words."""
    spans = repeats(docs, window, seed).groupBy(F.col("doc_id").alias("r_id"), F.col("sig").alias("r_sig")).agg(F.collect_set(F.struct("first", "n")).alias("spans"))
    spans = written(spans, "spans", small=True)
    texts = _texts(docs)
    return texts.join(bounded(spans, weight=1 + F.size("spans")), texts.doc_id.eqNullSafe(spans.r_id) & (texts.sig == spans.r_sig), "left").select("doc_id", "text", "sig", "spans")


def covered(n_words: int, spans: list[dict] | None, window: int) -> np.ndarray:
    """Which words lie in a repeated window; overlapping windows join to maximal repeats."""
    edges = np.zeros(n_words + 1, np.int64)
    for span in spans or ():
        edges[span["first"]] += 1
        edges[span["first"] + span["n"] + window - 1] -= 1
    return np.cumsum(edges)[:n_words] > 0


def deduplicated(docs: DataFrame, window: int = 35, seed: int = 12, texts: bool = False) -> DataFrame:
    """Remove each word covered by a window of ``window`` words that also starts elsewhere.

    Words are runs of anything but the six ASCII white-space characters, compared unchanged;
    elsewhere includes the same document, overlapping places too.  Windows are judged on the
    input, so no copy of a repeated window stays.  Returns per input row ``doc_id``,
    ``n_words``, ``n_removed``, ``kept_sha256`` of the kept words joined by one space, and with
    ``texts`` also ``kept``, those words.

    Null, empty and short texts have no windows and lose nothing.  Rows that repeat both id and
    text are places of their own, so they lose all their windows.  An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            n_words, n_removed, digests, kept = [], [], [], []
            for raw, spans in zip(raw_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = raw.split()
                gone = covered(len(words), spans, window)
                left = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if spans else b" ".join(words)
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "replace") if texts else None)
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.string())] if texts else columns, names=[*names, "kept"] if texts else names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if texts else "")
    return removed_words(docs, window, seed).select("doc_id", "text", "spans").mapInArrow(run, schema)
