"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_scratch: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing a temporary folder is used, which is right only for a
    local master; on a cluster the missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    own = getattr(context, "_mnemospark_shared", None)
    if own is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = context._mnemospark_shared = tempfile.mkdtemp(prefix="mnemospark-")
    return own


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended before: the cluster's own clean-up has the folder
        return


def own_folder(spark: SparkSession) -> str:
    """This application's folder within the shared one; it goes when the driver process ends."""
    top = f"{shared_folder(spark)}/mnemospark-{spark.sparkContext.applicationId}"
    if top not in _scratch:
        _scratch[top] = []
        atexit.register(_remove, spark, top)
    return top


#: Bytes of the tables read for each file written, at most, however few cores there are.
READ_PER_FILE = 64 << 20


def read_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a plan, by their sizes and without a job; tables that are not
    files have no known size and count nothing."""
    leaves, total = df._jdf.queryExecution().analyzed().collectLeaves().iterator(), 0
    while leaves.hasNext():
        size = int(str(leaves.next().stats().sizeInBytes()))
        total += size if size < 1 << 60 else 0
    return total


#: Whether Spark deletes the shuffle files of a query as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, small: bool = False, narrow: bool = False, per_core: int | None = None, files: int | None = None, clean: bool = False) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    Cuts lineage and keeps an expensive stage from running again for a second consumer; a
    lost executor loses nothing of it.  The folder goes when the driver process ends.

    Every file costs the folder's store a few calls, so what is small goes to few: ``small``,
    what an aggregation leaves, to at most one file a core of the cluster; ``per_core``, what
    comes from a shuffle of however many partitions, to at most so many; ``files``, to at most
    so many in all; ``narrow``, what a pass over texts tells in a few bytes a text, is dealt out
    to two a core, so that the pass keeps its own number of tasks.  Where the tables behind ``df``
    are large, :data:`READ_PER_FILE` raises all these numbers but ``files``, so that a task's share
    does not grow with the input.

    ``clean``: the shuffle files of the write go when it ends, not when the driver's garbage is next
    collected, so what a job of many such steps holds on disk is that of one.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if narrow or small or per_core or files:
        least = -(-read_bytes(df) // READ_PER_FILE)
        if narrow:
            df = df.repartition(max(2 * cores, least))
        else:
            df = df.coalesce(max(1, min(files or 1 << 30, max(cores * (per_core or 1), least))))
    top = own_folder(spark)
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    had = spark.conf.get(CLEANUP, "false")
    if clean:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if clean:
            spark.conf.set(CLEANUP, had)
    _scratch[top].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._mnemospark_path = path
    return out


def discard(table: DataFrame) -> None:
    """Delete a :func:`written` table that nothing reads any more."""
    _remove(table.sparkSession, table._mnemospark_path)
