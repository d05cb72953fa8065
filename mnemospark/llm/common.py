"""Helpers shared by the training-data operators.

Conventions that hold for every operator of the package:

* An operator first selects the columns it needs, so extra columns of the input, whatever
  their names, never meet the operator's own columns.
* A null text counts as an empty one unless the operator's docstring says otherwise.
* ``doc_id`` may be null or repeated.  Where rows have to meet again after a shuffle they
  meet on ``(doc_id, xxhash64(text))``, compared null-safe, so rows that repeat an id with
  another text stay apart and rows that repeat both get the same result.
* Intermediate tables go to the folder named by ``spark.checkpoint.dir``; nothing is kept in
  executors' local folders beyond Spark's own shuffle files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import written as written

#: The white space of all contracts: space, tab, line feed, vertical tab, form feed, return.
WHITE = b" \t\n\x0b\x0c\r"
#: The same set and its complement as regular expressions for Java, Python and DuckDB.
WHITE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def documents_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and ``sig``, a hash of the text that tells apart
    rows which repeat an id."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select("doc_id", body.alias("text")).withColumn("sig", F.xxhash64("text"))


def small_batches(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``most`` bytes of ``text`` (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        lengths = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        if lengths.sum() <= most:
            yield batch
            continue
        start = size = 0
        for k, n in enumerate(lengths):
            if k > start and size + n > most:
                yield batch.slice(start, k - start)
                start, size = k, 0
            size += int(n)
        yield batch.slice(start)


#: Bytes of a record batch that Spark hands to Python, about.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on this session hands Python record batches of about ``most`` bytes, a row at least;
    a lower setting stays.  Spark's own bound is 64 MB, which a task holds several times: in the
    buffers it writes, in those it sends and in the worker."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(setting, None)
    if now is None or not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) <= most:
        spark.conf.set(setting, str(most))


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """Each value of a string column as UTF-8 bytes; null as empty."""
    for value in column.cast(pa.binary()).to_pylist():
        yield value or b""


#: Rows of (id, hash, flag) up to which a table is broadcast: about 64 bytes each once hashed, so 64 MB.
BROADCAST_ROWS = 1_000_000


def bounded(small: DataFrame, most: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """``small``, a written table, marked for a broadcast if its counted rows are at most
    ``most``, else for a hash join whose sides both shuffle.  ``weight``: what a row counts,
    where rows hold lists or bytes."""
    rows = small.count() if weight is None else small.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(small) if rows <= most else small.hint("shuffle_hash")


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column's name as Spark reads it literally, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def rows_of(docs: DataFrame, decisions: DataFrame, kept: str, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that ``decisions`` keeps.

    ``decisions`` has a row for each row of ``docs``: ``doc_id``, ``sig`` (hash of the text) and
    the boolean ``kept``.  Of rows that repeat both id and text one stays if any is kept.  Only
    names of rows that go, or that repeat, meet the texts; while they are few they are broadcast
    and no text is shuffled.  Columns of ``docs`` may have any names.  Empty tables give no rows.
    """
    named, sig = [quoted(c) for c in docs.columns], fresh(docs, "text_sig")
    gone, once = fresh(docs, "gone"), fresh(docs, "once")
    marks = decisions.groupBy("doc_id", "sig").agg(F.count("*").alias("rows"), F.count_if(F.col(kept)).alias("stay"))
    marks = marks.filter("stay < rows or rows > 1").select(F.col("doc_id").alias("m_id"), F.col("sig").alias("m_sig"), (F.col("stay") == 0).alias("m_gone"))
    marks = written(marks, "marks", small=True)
    keyed = docs.withColumn(sig, F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    joined = keyed.join(bounded(marks), keyed["doc_id"].cast("long").eqNullSafe(marks["m_id"]) & (keyed[sig] == marks["m_sig"]), "left")
    joined = joined.select(*[keyed[c] for c in named], keyed[sig], marks["m_gone"].alias(gone))
    out = joined.filter(F.col(gone).isNull()).select(*named)
    if marks.filter("not m_gone").isEmpty():
        return out
    return out.union(joined.filter(~F.col(gone)).dropDuplicates(["doc_id", sig]).select(*named))
