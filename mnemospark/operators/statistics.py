"""A versioned store of corpus statistics that grows by batches.

A batch leaves sums: its number of documents, the document frequency of each word, and per
dimension of its vectors the count, the mean and the sum of squares about it.  Such sums merge, so
frequencies are always those of all batches.  Means and deviations are kept as a base, because fingerprints
of documents are taken about the base's means and would all have to be made anew: batches reuse
the base until what came after it is over half of what it was made from; then a new base is
made from the sums of all batches, without reading a document, and is what a fresh build gives.

Every attempt of a batch writes to its own folder; a snapshot, written last, names the attempts
that count and the base, so a repeated batch replaces itself and readers keep what they opened.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from .index import _names

SNAPSHOT = "batch long, attempt string, n long, in_base boolean, base string"
WORDS, SUMS = "word string, df long", "d int, n long, mean double, squares double"
BASE = "d int, mean double, std double"


class Statistics:
    """The statistics of one snapshot; appending returns those that follow."""

    def __init__(self, spark: SparkSession, path: str, growth: float = 0.5, floor: float = 1e-6):
        self.spark, self.path, self.growth, self.floor = spark, path.rstrip("/"), growth, floor
        done = [int(x.rsplit("v=", 1)[1].split("/")[0]) for x in _names(spark, f"{self.path}/snapshots/v=*/_SUCCESS")]
        self.version = max(done, default=0)
        rows = spark.read.schema(SNAPSHOT).parquet(f"{self.path}/snapshots/v={self.version:09d}").collect() if done else []
        self.entries = {r.batch: r.asDict() for r in rows}
        #: Name of the base; fingerprints made under it stay comparable while it is the same.
        self.base = rows[0].base if rows else None

    def append(self, docs: DataFrame, batch: int | None = None) -> Statistics:
        """Add documents (``doc_id``, ``text``, ``embedding``; either may be null).  ``batch`` is the
        number of a batch to write again; by default it is a new one."""
        number = batch if batch is not None else max(self.entries, default=-1) + 1
        attempt = f"{number}-{uuid.uuid4().hex}"
        words = docs.select(F.explode(F.array_distinct(T.trimmed_words(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
        words.write.parquet(f"{self.path}/words/attempt={attempt}")
        values = docs.select(F.posexplode(V.doubles(F.col("embedding"))).alias("d", "x"))
        sums = values.groupBy("d").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("squares"))
        sums.coalesce(1).write.parquet(f"{self.path}/sums/attempt={attempt}")
        entries = self.entries | {number: {"batch": number, "attempt": attempt, "n": docs.count(), "in_base": False}}
        built = sum(e["n"] for e in entries.values() if e["in_base"])
        late = sum(e["n"] for e in entries.values() if not e["in_base"])
        again = self.base is None or number in self.entries and self.entries[number]["in_base"] or late > self.growth * built
        base = uuid.uuid4().hex if again else self.base
        if again:
            entries = {n: e | {"in_base": True} for n, e in entries.items()}
            parts = self._read("sums", SUMS, entries.values())
            whole = parts.groupBy("d").agg(F.sum("n").alias("all"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("centre"))
            apart = parts.join(F.broadcast(whole), "d")  # a row per dimension
            squares = F.sum(F.col("squares") + F.col("n") * F.pow(F.col("mean") - F.col("centre"), F.lit(2)))
            total = apart.groupBy("d", "all", "centre").agg(F.sqrt(squares / F.first("all")).alias("spread"))
            total.select("d", F.col("centre").alias("mean"), F.greatest("spread", F.lit(self.floor)).alias("std")).coalesce(1).write.parquet(f"{self.path}/base/{base}")
        rows = [(n, e["attempt"], e["n"], e["in_base"], base) for n, e in sorted(entries.items())]
        self.spark.createDataFrame(rows, SNAPSHOT).coalesce(1).write.mode("error").parquet(f"{self.path}/snapshots/v={self.version + 1:09d}")
        return Statistics(self.spark, self.path, self.growth, self.floor)

    def _read(self, name: str, schema: str, entries) -> DataFrame:
        paths = [f"{self.path}/{name}/attempt={e['attempt']}" for e in entries]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @property
    def n_docs(self) -> int:
        return sum(e["n"] for e in self.entries.values())

    def dimensions(self) -> DataFrame:
        """``d``, ``mean``, ``std`` of the base."""
        return self.spark.read.schema(BASE).parquet(f"{self.path}/base/{self.base}") if self.base else self.spark.createDataFrame([], BASE)

    def frequencies(self) -> DataFrame:
        """``word``, ``df``, ``idf`` of all batches."""
        df = self._read("words", WORDS, self.entries.values()).groupBy("word").agg(F.sum("df").alias("df"))
        return df.select("word", "df", (F.log((F.lit(self.n_docs) + 1) / (F.col("df") + 1)) + 1).alias("idf"))
