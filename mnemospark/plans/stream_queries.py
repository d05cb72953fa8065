"""Queries whose operators also run on streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.statistics import Statistics
from ..scratch import own_folder
from ..streaming import ingest
from .registry import query
from .tables import table
from .text_queries import WORDS_SQL


@query("events_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_windows(spark, sf_dir):
    """An addition: event-time windows over the driver's events."""
    rows = table(spark, sf_dir, "events")
    return ingest.event_windows(rows).withColumn("start", F.col("start").cast(rows.schema["ts"].dataType)).withColumn("total", F.round("total", 4))


@query(
    "incremental_idf",
    f"""WITH w AS (SELECT DISTINCT doc_id, unnest({WORDS_SQL}) AS word FROM documents), f AS (SELECT word, count(*) AS df FROM w WHERE strlen(word) >= 3 GROUP BY word)
    SELECT word, df, round(ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1, 6) AS idf FROM f""",
)
def incremental_idf(spark, sf_dir):
    """Frequencies of two halves of the documents merged: the same as of the whole."""
    docs = table(spark, sf_dir, "documents")
    deltas = None
    for half in (docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 <> 0")):
        words = half.select(F.explode(F.array_distinct(T.trimmed_words(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
        part = words.unionByName(half.agg(F.lit(None).cast("string").alias("word"), F.count("*").alias("df")))
        deltas = part if deltas is None else deltas.unionByName(part)
    return ingest.merged_idf(deltas).withColumn("idf", F.round("idf", 6))


@query(
    "incremental_statistics",
    """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings),
    s AS (SELECT d, x, unnest(CASE WHEN vec_id % 10 < 6 THEN [0, 1, 2] ELSE [2] END) AS stage FROM v)
    SELECT stage, d::INTEGER AS d, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM s GROUP BY stage, d""",
)
def incremental_statistics(spark, sf_dir):
    """Six tenths of the vectors, then two that the base outlives, then two that make it anew."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(None).cast("string").alias("text"), "embedding")
    store = Statistics(spark, f"{own_folder(spark)}/statistics-{uuid.uuid4().hex}")
    out = None
    for stage, some in enumerate(("vec_id % 10 < 6", "vec_id % 10 in (6, 7)", "vec_id % 10 in (8, 9)")):
        store = store.append(rows.filter(some))
        part = store.dimensions().select(F.lit(stage).alias("stage"), "d", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))
        out = part if out is None else out.union(part)
    return out
