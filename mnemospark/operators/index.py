"""A stored index of texts: postings with positions, trigrams, a term dictionary and lengths.

Layout of the folder, all Parquet.  What a batch writes goes to paths of an attempt of its own,
``<batch>-<random>``, so nothing that is there already is touched:

* ``layout``: one row: number of buckets, type of the key, whether terms are stemmed;
* ``postings/attempt=a/bucket=b``: blocks ``term``, ``n`` and the lists ``docs``, ``tfs``, ``lengths``,
  ``positions`` (a list for each document), in order of term;
* ``trigrams/attempt=a/bucket=b``: blocks ``tri``, ``docs`` in order of trigram;
* ``terms/attempt=a``: ``term``, ``df``, ``bucket`` in files by range of term, for prefixes;
* ``lengths/attempt=a``: ``doc_id``, ``length`` (distinct terms);
* ``removed/attempt=a``: ``doc_id`` whose rows in batches before the attempt's do not count;
* ``snapshots/v=n``: a row for each batch that counts, with its attempt, and the totals.

A snapshot is written last and names all attempts that it is made of.  Readers follow the
snapshot they opened: a batch that failed is in none, a batch that is written again leaves the
next snapshot with its new attempt only, and readers of the one before go on with the old one.
Attempts that no snapshot needs go by :meth:`TextIndex.vacuum`.

A term's bucket is its CRC-32, which the driver computes too, so a query lists and reads the
buckets of its terms only, whatever the size of the rest.  Blocks are made in one pass over the
texts, one per term and record batch, and dealt to the buckets' files by rebalancing, which
splits a bucket that is too large for a task.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stem import stem, stems

LAYOUT = "buckets int, key string, stemmed boolean"
SNAPSHOT = "batch long, attempt string, patches array<string>, removes boolean, n_docs long, n_terms long, all_docs long, all_terms long"
POSTINGS = "term string, n int, docs array<{0}>, tfs array<int>, lengths array<int>, positions array<array<int>>"
TRIGRAMS = "tri string, docs array<{0}>"
LENGTHS = "doc_id {0}, length long"
REMOVED = "doc_id {0}"
TERMS = "term string, df long, bucket int"
#: Documents in a block of a compacted index, about.
BLOCK = 8192
#: Words, and bytes of text, from which blocks are made at once: about 100 MB of arrays.
WORDS_AT_ONCE, BYTES_AT_ONCE = 1 << 20, 2 << 20


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, by the file system and without a job."""
    path, files = _path(spark, pattern)
    return sorted(x.getPath().toString() for x in files.globStatus(path) or [])


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(F.encode(term, "UTF-8")), F.lit(buckets)).cast("int")


def _buckets(terms: list[str], buckets: int) -> pa.Array:
    return pa.array([zlib.crc32(t.encode()) % buckets for t in terms], pa.int32())


def _starts(changed: np.ndarray) -> np.ndarray:
    """Offsets of the runs that begin where ``changed`` is true (never asked of the first)."""
    return np.concatenate(([0], np.flatnonzero(changed) + 1, [len(changed) + 1]))


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def posting_blocks(ids: pa.Array, lengths: pa.Array, words: pa.ListArray, buckets: int) -> pa.RecordBatch | None:
    """A block per term of some documents: which of them, how often and where."""
    counts = np.diff(words.offsets.to_numpy())
    if not counts.sum():
        return None
    coded = words.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(ids)), counts)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    code = coded.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    code, doc, pos = code[order], doc[order], pos[order]
    pairs = _starts((np.diff(code) != 0) | (np.diff(doc) != 0))
    first = pairs[:-1]
    blocks = _starts(np.diff(code[first]) != 0)
    names = coded.dictionary.take(pa.array(code[first][blocks[:-1]]))
    owners = pa.array(doc[first])
    places = _lists(blocks, _lists(pairs, pa.array(pos, pa.int32())))
    return pa.record_batch(
        {
            "bucket": _buckets(names.to_pylist(), buckets),
            "term": names,
            "n": pa.array(np.diff(blocks), pa.int32()),
            "docs": _lists(blocks, ids.take(owners)),
            "tfs": _lists(blocks, pa.array(np.diff(pairs), pa.int32())),
            "lengths": _lists(blocks, lengths.take(owners).cast(pa.int32())),
            "positions": places,
        }
    )


def trigram_blocks(ids: pa.Array, texts: list[str], buckets: int) -> pa.RecordBatch | None:
    """A block per run of three characters of some lower-cased texts: which of them hold it."""
    keys, docs = [], []
    for k, text in enumerate(texts):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if len(points) > 2:
            found = np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:])
            keys.append(found)
            docs.append(np.full(len(found), k))
    if not keys:
        return None
    key, doc = np.concatenate(keys), np.concatenate(docs)
    order = np.argsort(key, kind="stable")
    key = key[order]
    blocks = _starts(np.diff(key) != 0)
    names = ["".join(chr(int(x) >> shift & 0x1FFFFF) for shift in (42, 21, 0)) for x in key[blocks[:-1]]]
    return pa.record_batch({"bucket": _buckets(names, buckets), "tri": pa.array(names), "docs": _lists(blocks, ids.take(pa.array(doc[order])))})


def _cut(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``most`` words or bytes of a column (a row at least), so that the
    arrays made from a part stay small whatever Spark hands over."""
    for batch in batches:
        values = batch.column(column)
        sizes = (values.value_lengths() if pa.types.is_list(values.type) else pc.binary_length(values)).fill_null(0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


class TextIndex:
    """The batches of one snapshot; whatever changes the index returns the one that follows."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, key: str, stemmed: bool, version: int | None = None):
        self.spark, self.path, self.buckets, self.key, self.stemmed = spark, path.rstrip("/"), buckets, key, stemmed
        done = self._versions()
        self.version = version if version is not None else max(done, default=0)
        if self.version and self.version not in done:
            raise ValueError(f"no snapshot {version} in {path}")
        rows = spark.read.schema(SNAPSHOT).parquet(self._snapshot(self.version)).collect() if self.version else []
        self.entries = {r.batch: r for r in rows}
        self.batches = sorted(self.entries)

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int = 64, key: str = "long", stemmed: bool = False) -> TextIndex:
        """An empty index; ``buckets`` grows with the vocabulary's share of the data (64 for a
        few GB, thousands for many TB) and is fixed from then on."""
        spark.createDataFrame([(buckets, key, stemmed)], LAYOUT).coalesce(1).write.parquet(f"{path}/layout")
        return cls(spark, path, buckets, key, stemmed)

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> TextIndex:
        """The latest snapshot, or an earlier one that has not been vacuumed."""
        return cls(spark, path, *spark.read.schema(LAYOUT).parquet(f"{path}/layout").first(), version=version)

    def _snapshot(self, version: int) -> str:
        return f"{self.path}/snapshots/v={version:09d}"

    def _versions(self) -> list[int]:
        return [int(x.rsplit("v=", 1)[1].split("/")[0]) for x in _names(self.spark, f"{self.path}/snapshots/v=*/_SUCCESS")]

    # -- writing

    def append(self, docs: DataFrame, batch: int | None = None) -> TextIndex:
        """Add documents (``doc_id``, ``text``; null text: empty).  A ``doc_id`` that the index
        has already is replaced; within ``docs`` it must be unique.  ``batch`` is a new number, by
        default one more than the largest, or that of a batch to write again: its documents and
        what they replaced are then as if only ``docs`` had ever been written under it."""
        number = self._number(batch)
        attempt = self._attempt(number)
        key, buckets = self.key, self.buckets
        found = docs.select(F.col("doc_id").cast(key).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        cores = self.spark.sparkContext.defaultParallelism
        if found.rdd.getNumPartitions() < cores:  # few files: less than a task for every core
            found = found.repartition(cores)
        all_terms = T.tokens(F.col("text"))
        sized = found.select("doc_id", (stems(all_terms) if self.stemmed else all_terms).alias("all")).select("doc_id", F.size(F.array_distinct("all")).cast("long").alias("length"), "all")

        def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _cut(batches, 2, WORDS_AT_ONCE):
                if (made := posting_blocks(b.column(0), b.column(1), b.column(2), buckets)) is not None:
                    yield made

        def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _cut(batches, 1, BYTES_AT_ONCE):
                if (made := trigram_blocks(b.column(0), b.column(1).to_pylist(), buckets)) is not None:
                    yield made

        self._write(sized.select("doc_id", "length"), "lengths", attempt)
        self._deal(sized.mapInArrow(postings, "bucket int, " + POSTINGS.format(key)), "postings", "term", attempt)
        lowered = found.select("doc_id", F.lower("text").alias("low"))
        self._deal(lowered.mapInArrow(trigrams, "bucket int, " + TRIGRAMS.format(key)), "trigrams", "tri", attempt)
        self._dictionary(attempt)
        added = self._attempts("lengths", LENGTHS, [attempt]).select("doc_id", "length")
        before = [n for n in self.batches if n < number]
        replaced = self._lengths(before).join(added.select("doc_id"), "doc_id", "left_semi")
        n_docs, n_terms = added.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        entry = {"batch": number, "attempt": attempt, "patches": [], "removes": False, "n_docs": n_docs, "n_terms": n_terms}
        gone = (0, 0)
        if before:
            gone = replaced.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
            if gone[0]:  # without removals queries need no join
                self._write(replaced.select("doc_id"), "removed", attempt)
                entry["removes"] = True
        return self._commit(entry, self._patches(number, added), (n_docs - gone[0], n_terms - gone[1]))

    def remove(self, doc_ids: DataFrame, batch: int | None = None) -> TextIndex:
        """Documents leave the index; ids it does not have change nothing."""
        number = self._number(batch)
        attempt = self._attempt(number)
        ids = doc_ids.select(F.col("doc_id").cast(self.key).alias("doc_id")).distinct()
        self._write(ids, "removed", attempt)
        ids = self._attempts("removed", REMOVED, [attempt]).select("doc_id")
        gone = self._lengths([n for n in self.batches if n < number]).join(ids, "doc_id", "left_semi").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        entry = {"batch": number, "attempt": attempt, "patches": [], "removes": True, "n_docs": 0, "n_terms": 0}
        return self._commit(entry, {}, (-gone[0], -gone[1]))

    def _patches(self, number: int, added: DataFrame) -> dict[int, str]:
        """Later batches hold only those removals that there were when they were written; where
        batch ``number`` is written again with documents that they have too, these are added."""
        out = {}
        for later in (n for n in self.batches if n > number and self.entries[n].n_docs):
            both = self._attempts("lengths", LENGTHS, [self.entries[later].attempt]).select("doc_id").join(added.select("doc_id"), "doc_id", "left_semi")
            if not both.isEmpty():
                out[later] = self._attempt(later)
                self._write(both, "removed", out[later])
        return out

    def compacted(self, into: str, buckets: int | None = None) -> TextIndex:
        """All that counts as one batch of a new index, with room for more buckets and with the
        blocks of a term merged to such of about ``BLOCK`` documents."""
        new = TextIndex.create(self.spark, into, buckets or self.buckets, self.key, self.stemmed)
        attempt = new._attempt(0)
        new._write(self._lengths(self.batches), "lengths", attempt)
        postings = self._blocks("postings", POSTINGS).select("batch", "term", F.inline(F.arrays_zip("docs", "tfs", "lengths", "positions"))).withColumnRenamed("docs", "doc_id")
        trigrams = self._blocks("trigrams", TRIGRAMS).select("batch", "tri", F.explode("docs").alias("doc_id"))
        for rows, name, term, lists in ((postings, "postings", "term", ["tfs", "lengths", "positions"]), (trigrams, "trigrams", "tri", [])):
            live = self._live(rows)
            chunks = live.groupBy(F.col(term).alias("of")).agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))
            placed = live.join(chunks, F.col(term) == F.col("of")).withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")))
            made = placed.groupBy(term, "chunk").agg(F.array_sort(F.collect_list(F.struct("doc_id", *lists))).alias("r"))
            n = [F.size("r").alias("n")] if lists else []
            made = made.select(_bucket(F.col(term), new.buckets).alias("bucket"), term, *n, F.col("r.doc_id").alias("docs"), *[F.col(f"r.{x}").alias(x) for x in lists])
            new._deal(made, name, term, attempt)
        new._dictionary(attempt)
        entry = {"batch": 0, "attempt": attempt, "patches": [], "removes": False, "n_docs": self.totals[0], "n_terms": self.totals[1]}
        return new._commit(entry, {}, self.totals)

    def vacuum(self, keep: int = 1) -> None:
        """Delete what the latest ``keep`` snapshots do not need; no other may be in use."""
        versions = sorted(self._versions())
        needed = {a for v in versions[-keep:] for e in TextIndex.open(self.spark, self.path, v).entries.values() for a in (e.attempt, *e.patches)}
        old = [p for p in _names(self.spark, f"{self.path}/*/attempt=*") if p.rsplit("attempt=", 1)[1] not in needed]
        for p in old + [self._snapshot(v) for v in versions[:-keep]]:
            path, files = _path(self.spark, p)
            files.delete(path, True)

    def _number(self, batch: int | None) -> int:
        return batch if batch is not None else (self.batches[-1] + 1 if self.batches else 0)

    @staticmethod
    def _attempt(batch: int) -> str:
        return f"{batch}-{uuid.uuid4().hex}"

    def _write(self, rows: DataFrame, name: str, attempt: str) -> None:
        rows.write.option("compression", "zstd").parquet(f"{self.path}/{name}/attempt={attempt}")

    def _deal(self, blocks: DataFrame, name: str, term: str, attempt: str) -> None:
        dealt = blocks.hint("rebalance", "bucket").sortWithinPartitions("bucket", term)
        dealt.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/{name}/attempt={attempt}")

    def _dictionary(self, attempt: str) -> None:
        """Terms of a batch by range, from the numbers of its blocks alone."""
        counted = self._attempts("postings", "term string, n int", [attempt], "*").groupBy("term").agg(F.sum("n").alias("df"), F.first("bucket").alias("bucket"))
        self._write(counted.repartitionByRange("term").sortWithinPartitions("term"), "terms", attempt)

    def _commit(self, entry: dict, patches: dict[int, str], change: tuple[int, int]) -> TextIndex:
        """The next snapshot; ``change``: what a batch after all others adds to the totals.  Two
        writers of one version cannot both succeed: the second finds its path taken."""
        number = entry["batch"]
        entries = {n: {x: r[x] for x in entry} for n, r in self.entries.items()} | {number: entry}
        for later, patch in patches.items():
            entries[later] = entries[later] | {"patches": [*entries[later]["patches"], patch], "removes": True}
        if self.batches and number <= self.batches[-1]:
            rows = [{**e, "all_docs": 0, "all_terms": 0} for e in entries.values()]
            draft = object.__new__(TextIndex)
            draft.__dict__.update(spark=self.spark, path=self.path, buckets=self.buckets, key=self.key, stemmed=self.stemmed, version=self.version)
            draft.entries = {r.batch: r for r in self.spark.createDataFrame(rows, SNAPSHOT).collect()}
            draft.batches = sorted(draft.entries)
            totals = draft._lengths(draft.batches).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        else:
            totals = [a + b for a, b in zip(self.totals, change, strict=True)]
        rows = [{**e, "all_docs": totals[0], "all_terms": totals[1]} for e in entries.values()]
        self.spark.createDataFrame(rows, SNAPSHOT).coalesce(1).write.mode("error").parquet(self._snapshot(self.version + 1))
        return TextIndex(self.spark, self.path, self.buckets, self.key, self.stemmed, self.version + 1)

    # -- reading

    def _attempts(self, name: str, schema: str, attempts: Iterable[str], bucket: str | None = None) -> DataFrame:
        """Rows of the attempts with their ``batch``; only the folders asked for are listed.
        ``bucket``: a pattern of buckets, for what lies in buckets."""
        top, wanted = f"{self.path}/{name}", set(attempts)
        found = _names(self.spark, f"{top}/attempt=*" + (f"/bucket={bucket}" if bucket else ""))
        paths = [p for p in found if p.split("/attempt=", 1)[1].split("/")[0] in wanted]
        whole = schema.format(self.key) + ", attempt string" + (", bucket int" if bucket else "")
        rows = self.spark.read.schema(whole).option("basePath", top).parquet(*paths) if paths else self.spark.createDataFrame([], whole)
        return rows.withColumn("batch", F.substring_index("attempt", "-", 1).cast("long"))

    def _blocks(self, name: str, schema: str, terms: Iterable[str] | None = None) -> DataFrame:
        numbers = None if terms is None else sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})
        return self._attempts(name, schema, [e.attempt for e in self.entries.values()], "*" if numbers is None else f"{{{','.join(map(str, numbers))}}}")

    def _live(self, rows: DataFrame, batches: Iterable[int] | None = None) -> DataFrame:
        """Rows (``batch``, ``doc_id``) that no later batch has removed, without ``batch``."""
        removing = [self.entries[n] for n in (self.batches if batches is None else batches) if self.entries[n].removes]
        if not removing:
            return rows.drop("batch")
        gone = self._attempts("removed", REMOVED, [a for e in removing for a in (e.attempt, *e.patches)]).groupBy(F.col("doc_id").alias("gone")).agg(F.max("batch").alias("until"))
        return rows.join(gone, (F.col("doc_id") == F.col("gone")) & (F.col("batch") < F.col("until")), "left_anti").drop("batch")

    def _lengths(self, batches: Iterable[int]) -> DataFrame:
        numbers = list(batches)
        rows = self._attempts("lengths", LENGTHS, [self.entries[n].attempt for n in numbers]).drop("attempt")
        return self._live(rows, numbers)

    @cached_property
    def totals(self) -> tuple[int, int]:
        """Number of documents, sum of their distinct terms, as the snapshot has them."""
        return next(((e.all_docs, e.all_terms) for e in self.entries.values()), (0, 0))

    def query_terms(self, terms: Sequence[str]) -> list[str]:
        return [stem(t) for t in terms] if self.stemmed else list(terms)

    def _hits(self, terms: Sequence[str], *lists: str) -> DataFrame:
        asked = list(dict.fromkeys(terms))
        rows = self._blocks("postings", POSTINGS, asked).filter(F.col("term").isin(*asked))
        return self._live(rows.select("batch", "term", F.inline(F.arrays_zip("docs", *lists))).withColumnRenamed("docs", "doc_id"))

    def postings(self, terms: Sequence[str]) -> DataFrame:
        """``term``, ``doc_id``, ``tf``, ``length`` of the terms, from their buckets."""
        hits = self._hits(terms, "tfs", "lengths")
        return hits.select("term", "doc_id", F.col("tfs").cast("long").alias("tf"), F.col("lengths").cast("long").alias("length"))

    def postings_of(self, terms: DataFrame) -> DataFrame:
        """:meth:`postings` of a table of terms (``term``), as many as there may be: the driver
        learns which buckets they are in, no term.  Of a stemmed index they are stems."""
        wanted = terms.select("term").distinct()
        numbers = [str(r.b) for r in wanted.select(_bucket(F.col("term"), self.buckets).alias("b")).distinct().collect()]
        blocks = self._attempts("postings", POSTINGS, [e.attempt for e in self.entries.values()], f"{{{','.join(numbers or ['none'])}}}")
        met = blocks.join(wanted, "term").select("batch", "term", F.inline(F.arrays_zip("docs", "tfs", "lengths"))).withColumnRenamed("docs", "doc_id")
        return self._live(met).select("term", "doc_id", F.col("tfs").cast("long").alias("tf"), F.col("lengths").cast("long").alias("length"))

    def positions(self, terms: Sequence[str]) -> DataFrame:
        """``term``, ``doc_id``, ``pos`` (from 0) of every occurrence of the terms."""
        return self._hits(terms, "positions").select("term", "doc_id", F.explode("positions").alias("pos"))

    def phrase(self, terms: Sequence[str]) -> DataFrame:
        """``doc_id`` and ``n``, how often the terms follow each other there; no text is read."""
        places = F.explode(F.array(*[F.struct(F.lit(t).alias("of"), F.lit(k).alias("at")) for k, t in enumerate(terms)]))
        order = self.spark.range(1).select(places.alias("p")).select("p.of", "p.at")  # a row per term asked
        hits = self.positions(terms).join(F.broadcast(order), F.col("term") == F.col("of"))
        starts = hits.groupBy("doc_id", (F.col("pos") - F.col("at")).alias("start")).agg(F.count("*").alias("k")).filter(F.col("k") == len(terms))
        return starts.groupBy("doc_id").agg(F.count("*").alias("n"))

    def terms_with(self, prefix: str) -> DataFrame:
        """``term`` and ``df`` of the terms that begin with ``prefix``.  Files lie by range of term, so
        the scan reads those of the prefix.  ``df`` counts replaced documents until compaction."""
        rows = self._attempts("terms", TERMS, [e.attempt for e in self.entries.values()])
        return rows.filter(F.startswith("term", F.lit(prefix))).groupBy("term").agg(F.sum("df").alias("df"))

    def postings_with(self, prefix: str) -> DataFrame:
        """:meth:`postings` of all terms that begin with ``prefix``, from the buckets that the
        dictionary names (at most all there are)."""
        rows = self._attempts("terms", TERMS, [e.attempt for e in self.entries.values()]).filter(F.startswith("term", F.lit(prefix)))
        numbers = [str(r.bucket) for r in rows.select("bucket").distinct().collect()]
        blocks = self._attempts("postings", POSTINGS, [e.attempt for e in self.entries.values()], f"{{{','.join(numbers or ['none'])}}}").filter(F.startswith("term", F.lit(prefix)))
        hits = self._live(blocks.select("batch", "term", F.inline(F.arrays_zip("docs", "tfs", "lengths"))).withColumnRenamed("docs", "doc_id"))
        return hits.select("term", "doc_id", F.col("tfs").cast("long").alias("tf"), F.col("lengths").cast("long").alias("length"))

    def contents(self) -> tuple[DataFrame, DataFrame]:
        """All postings (``term``, ``doc_id``, ``tf``, ``length``, ``positions``) and all trigrams (``tri``,
        ``doc_id``) that count."""
        postings = self._blocks("postings", POSTINGS).select("batch", "term", F.inline(F.arrays_zip("docs", "tfs", "lengths", "positions"))).withColumnRenamed("docs", "doc_id")
        trigrams = self._blocks("trigrams", TRIGRAMS).select("batch", "tri", F.explode("docs").alias("doc_id"))
        return self._live(postings).withColumnsRenamed({"tfs": "tf", "lengths": "length"}), self._live(trigrams)

    def stats(self, terms: Sequence[str]) -> DataFrame:
        """What :func:`mnemospark.operators.text.lexical_stats` gives, without reading a text."""
        hits = self.postings(terms)
        df = hits.groupBy("term").agg(F.count("*").alias("df"))
        n_docs, n_terms = self.totals
        mean = max(n_terms / n_docs, 1.0) if n_docs else 1.0
        return hits.join(F.broadcast(df), "term").withColumn("n_docs", F.lit(n_docs).cast("long")).withColumn("mean_length", F.lit(mean))  # df: a row per term asked

    def trigram_candidates(self, pattern: str) -> DataFrame:
        """``doc_id`` of documents with every trigram of a pattern of three characters or more:
        the intersection of posting lists.  A shorter pattern has no trigram and is an error;
        :func:`mnemospark.operators.text.trigram_candidates` scans for it."""
        low = pattern.lower()
        wanted = sorted({low[k : k + 3] for k in range(len(low) - 2)})
        if not wanted:
            raise ValueError("a pattern under three characters has no trigram")
        rows = self._blocks("trigrams", TRIGRAMS, wanted).filter(F.col("tri").isin(*wanted)).select("batch", F.explode("docs").alias("doc_id"))
        return self._live(rows).groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select("doc_id")
