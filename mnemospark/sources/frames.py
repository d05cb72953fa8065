"""The frame table: versions of text memories, append-only.

A frame is one version of a document.  Only ``status`` ever changes, and it changes by a later
event, so the current state is a window over the history and no row is updated in place.
"""

from __future__ import annotations

import io

import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACTIVE, TOMBSTONE, DELETED = "active", "tombstone", "deleted"

SCHEMA = T.StructType(
    [
        T.StructField("frame_id", T.LongType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("status", T.StringType()),
        T.StructField("memory_type", T.StringType()),
        T.StructField("memory_kind", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("scope", T.StringType()),
        T.StructField("pillar", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("superseded_by", T.LongType()),
        T.StructField("semantic_delta", T.DoubleType()),
        T.StructField("checksum", T.StringType()),
    ]
)

PILLARS = ("episodic", "semantic", "procedural", "external", "code", "memory", "document")


def conform(df: DataFrame) -> DataFrame:
    """Any table with some of the frame columns as a frame table; missing ones are null."""
    return df.select(*[(F.col(x.name) if x.name in df.columns else F.lit(None)).cast(x.dataType).alias(x.name) for x in SCHEMA])


def create_store(spark: SparkSession) -> DataFrame:
    """An empty frame table."""
    return spark.createDataFrame([], SCHEMA)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The frame table at ``path``, with the schema given, never inferred."""
    return spark.read.schema(SCHEMA).parquet(path)


def to_bytes(frames: DataFrame) -> bytes:
    """A small store as one Parquet file in memory, to be sent or embedded; it has to fit the driver."""
    out = io.BytesIO()
    pq.write_table(conform(frames).toArrow(), out, compression="zstd")
    return out.getvalue()


def open_bytes(spark: SparkSession, data: bytes) -> DataFrame:
    """The frame table in the bytes of a Parquet file, with the schema given; other columns are
    ignored, missing ones are null."""
    return conform(spark.createDataFrame(pq.read_table(io.BytesIO(data))))


def save(frames: DataFrame, path: str, mode: str = "append") -> None:
    """Append frames as zstd Parquet, one folder per pillar so that pillar filters prune."""
    conform(frames).write.mode(mode).option("compression", "zstd").partitionBy("pillar").parquet(path)


def compact(spark: SparkSession, path: str, into: str, files: int) -> None:
    """Rewrite a store of many small files as ``files`` larger ones per pillar."""
    open_store(spark, path).repartition(files).write.option("compression", "zstd").partitionBy("pillar").parquet(into)


def pillar_of_role(role: Column) -> Column:
    return F.when(role == "system", "procedural").when(role == "assistant", "semantic").otherwise("episodic")


def from_conversations(conversations: DataFrame) -> DataFrame:
    """Conversations as versions: each turn is a frame of its conversation's document."""
    hold = F.when(F.col("conv_id") % 7 == 0, F.array(F.lit("legal_hold:c1"))).otherwise(F.array().cast("array<string>"))
    rows = conversations.select(
        (F.col("conv_id") * (1 << 20) + F.col("turn")).alias("frame_id"),
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("doc_id"),
        F.col("text").alias("content"),
        F.expr("TIMESTAMP '2024-01-01' + make_dt_interval(cast(conv_id as int), 0, cast(turn as int), 0)").alias("created_at"),
        pillar_of_role(F.col("role")).alias("pillar"),
        F.concat(F.array(F.concat(F.lit("role:"), "role"), F.concat(F.lit("turn:"), F.col("turn").cast("string"))), hold).alias("tags"),
        F.col("conv_id"),
        F.col("turn"),
    )
    from ..operators.frames import superseding

    return superseding(rows)
