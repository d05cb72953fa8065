"""Tables that queries start from, in Spark and as SQL for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.index import TextIndex
from ..scratch import own_folder
from ..sources.frames import from_conversations


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_conversations(table(spark, sf_dir, "conversations"))


#: Indexes built in this process, by application and folder, with the files they were built from.
_indexes: dict[tuple[str, str], tuple[list[tuple[str, int, int]], TextIndex]] = {}


def _files(spark: SparkSession, folder: str) -> list[tuple[str, int, int]]:
    """Names, sizes and times of a table's files, by the file system and without a job."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while files.hasNext():
        one = files.next()
        found.append((one.getPath().toString(), one.getLen(), one.getModificationTime()))
    return sorted(found)


def build_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """A new index of all documents in the shared folder, used by the queries that follow."""
    path, files = f"{own_folder(spark)}/index-{uuid.uuid4().hex}", _files(spark, f"{sf_dir}/documents.parquet")
    index = TextIndex.create(spark, path).append(table(spark, sf_dir, "documents").select("doc_id", "text"))
    _indexes[spark.sparkContext.applicationId, sf_dir] = files, index
    return index


def text_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The index of all documents, built by the application's first query that needs it, and
    again where the table's files have changed."""
    files, index = _indexes.get((spark.sparkContext.applicationId, sf_dir), (None, None))
    return index if files == _files(spark, f"{sf_dir}/documents.parquet") else build_index(spark, sf_dir)


#: The same frames as :func:`frames`: common table expressions to begin an oracle with.
FRAMES_SQL = """
c0 AS (
  SELECT conv_id * 1048576 + turn AS frame_id, 'conv_' || conv_id AS doc_id, text AS content,
         TIMESTAMP '2024-01-01' + to_days(conv_id::INTEGER) + to_minutes(turn) AS created_at,
         CASE role WHEN 'system' THEN 'procedural' WHEN 'assistant' THEN 'semantic' ELSE 'episodic' END AS pillar,
         list_concat(['role:' || role, 'turn:' || turn], CASE WHEN conv_id % 7 = 0 THEN ['legal_hold:c1'] ELSE []::VARCHAR[] END) AS tags,
         conv_id, turn
  FROM conversations),
c1 AS (SELECT *, lead(frame_id) OVER (PARTITION BY doc_id ORDER BY created_at, frame_id) AS superseded_by FROM c0),
frames AS (SELECT *, CASE WHEN superseded_by IS NULL THEN 'active' ELSE 'tombstone' END AS status FROM c1)
"""

#: Words of documents: runs of letters, digits and underscores, lower-cased.
TOKENS_SQL = r"""
tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents WHERE text IS NOT NULL)
"""
