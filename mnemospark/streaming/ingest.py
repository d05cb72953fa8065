"""Bounded ingest, incremental statistics and stateful recall as streams.

Each operator has a batch twin in ``operators``; tests hold stream and batch results equal.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from ..operators.index import TextIndex
from ..operators.statistics import Statistics


def append_frames(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Frames of a stream appended to a store, each micro-batch once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incremental_df(stream: DataFrame, stats_path: str, checkpoint: str) -> StreamingQuery:
    """Document frequencies of new documents, one table of deltas per micro-batch.

    A repeated batch overwrites its own folder, so frequencies stay exact after a restart; the
    sum over all folders is the frequency table, the same as over all documents at once.
    """

    def add(batch: DataFrame, number: int) -> None:
        words = batch.select(F.explode(F.array_distinct(T.trimmed_words(F.col("text")))).alias("word"))
        counts = words.groupBy("word").agg(F.count("*").alias("df"))
        n = batch.agg(F.lit(None).cast("string").alias("word"), F.count("*").alias("df"))
        counts.unionByName(n).write.mode("overwrite").parquet(f"{stats_path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_texts(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Documents of a stream added to the index at ``path``, a micro-batch a batch; one that is
    repeated after a failure replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        TextIndex.open(batch.sparkSession, path).append(batch, number)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def statistics(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Corpus statistics of a stream of documents, a micro-batch a batch; one that is repeated
    after a failure replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        Statistics(batch.sparkSession, path).append(batch, number)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_idf(deltas: DataFrame) -> DataFrame:
    """``word``, ``df``, ``idf`` from all deltas; the row without a word counts documents."""
    n = F.broadcast(deltas.filter("word is null").agg(F.sum("df").alias("n")))  # one row
    df = deltas.filter("word is not null").groupBy("word").agg(F.sum("df").alias("df"))
    return df.crossJoin(n).select("word", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def accumulator(stream: DataFrame, key: str, threshold: int = 150) -> DataFrame:
    """A row ``key``, ``fired``, ``rest`` per micro-batch and key: the running sum of ``score``
    fires and starts again at the threshold.  Rows of a batch are taken in order of ``seq``."""

    def run(keys: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        total, fired = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        for score in rows["score"].tolist():
            total += score
            if total >= threshold:
                total, fired = 0, fired + 1
        state.update((total, fired))
        yield pd.DataFrame({key: [keys[0]], "fired": [fired], "rest": [total]})

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} string, fired long, rest long", "total long, fired long", "update", GroupStateTimeout.NoTimeout)


def recall_state(stream: DataFrame) -> DataFrame:
    """Recall count and weight per document (``doc_id``, ``burst``, ``seq``), kept as state."""

    def run(keys: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        n, w = state.get if state.exists else (0, 1.0)
        for burst in pd.concat(list(batches)).sort_values("seq")["burst"].tolist():
            n += 1
            w = min(2.0, w + 0.05 / n**0.5 + (0.15 if burst else 0.0))
        state.update((n, w))
        yield pd.DataFrame({"doc_id": [keys[0]], "recall_count": [n], "weight": [w]})

    return stream.groupBy("doc_id").applyInPandasWithState(run, "doc_id string, recall_count long, weight double", "n long, w double", "update", GroupStateTimeout.NoTimeout)


def event_windows(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and value sums by event type and window; works on streams and tables alike."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = source.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")
