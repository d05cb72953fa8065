"""History, status and retention of frames, as windows and filters over the append-only table.

Every window is partitioned by document, so history is as parallel as there are documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import written
from ..sources.frames import ACTIVE, DELETED, TOMBSTONE
from . import ordered


def _versions() -> Window:
    return Window.partitionBy("doc_id").orderBy("created_at", "frame_id")


def superseding(frames: DataFrame) -> DataFrame:
    """``superseded_by``, the next version's id, and ``status``: the last version is active."""
    following = F.lead("frame_id").over(_versions())
    return frames.withColumn("superseded_by", following).withColumn("status", F.when(F.col("superseded_by").isNull(), ACTIVE).otherwise(TOMBSTONE))


def put(frames: DataFrame, new: DataFrame) -> DataFrame:
    """Append versions; whatever was active of the same documents becomes a tombstone."""
    keep = [c for c in frames.columns if c not in ("status", "superseded_by")]
    return superseding(frames.select(*keep).unionByName(new.select(*keep)))


# What a pillar puts before its own ids, and the kind of memory that it is.
PREFIXES = {"episodic": "ep_", "semantic": "sem_", "procedural": "proc_", "external": "ext_", "code": "code_", "memory": "mem_", "document": "doc_"}
MEMORY_TYPES = {"episodic": "episodic", "semantic": "factual", "procedural": "procedural", "external": "factual", "code": "factual", "memory": "relational", "document": "factual"}


def _numbered(frames: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` with ``number``, from the number of frames on without gaps in order of reading, and
    ``frame_id``, from the largest on.  Rows are counted per partition, so none are moved."""
    rows = written(new.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__row", 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("__row").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per partition
    starts = written(counts.select("part", "first", before.alias("before")), "starts", files=1)
    have = frames.agg(F.count("*").alias("have"), F.coalesce(F.max("frame_id") + 1, F.lit(0)).alias("next"))
    placed = rows.join(F.broadcast(starts), part == F.col("part")).crossJoin(F.broadcast(have)).withColumn("at", F.col("before") + F.col("__row") - F.col("first"))  # a row per partition; one row
    return placed.withColumn("number", F.col("have") + F.col("at")).withColumn("frame_id", F.col("next") + F.col("at")).drop("__row", "part", "first", "before", "have", "next", "at")


def remember(frames: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (``content``) as frames with ids ``mem_`` and the number of frames before each."""
    return _numbered(frames, new).withColumn("doc_id", F.concat(F.lit("mem_"), F.col("number").cast("string"))).drop("number")


def remember_as(frames: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (``doc_id``, ``content``, ``title``) as frames tagged ``link:`` with each concept
    that the content links to; whole, never cut."""
    tags = F.transform(T.wikilinks(F.coalesce("content", F.lit(""))), lambda c: F.concat(F.lit("link:"), c))
    return _numbered(frames, new).withColumn("tags", tags).withColumn("memory_type", F.lit("episodic")).drop("number")


def remember_with_pillar(frames: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (``doc_id`` or null, ``content``, ``pillar``, ``tags``) as frames: a null id is the
    pillar's prefix and a number, the pillar is a tag too and gives the kind of memory.  Links
    are not looked for, since code has double brackets of its own."""
    of = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("pillar")]
    own = F.concat(of(PREFIXES), F.col("number").cast("string"))
    tags = F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.concat(F.lit("pillar:"), "pillar")))
    return _numbered(frames, new).withColumn("doc_id", F.coalesce("doc_id", own)).withColumn("tags", tags).withColumn("memory_type", of(MEMORY_TYPES)).drop("number")


def put_binary(frames: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (``doc_id``, ``payload``, ``pillar``, ``tags``) as frames whose content is bytes."""
    return _numbered(frames, new).withColumn("content", F.lit(None).cast("string")).withColumn("memory_type", F.lit("episodic")).drop("number")


def read_binary(frames: DataFrame) -> DataFrame:
    """``doc_id``, ``payload`` of active frames: their bytes, or their text in UTF-8."""
    return current(frames).select("doc_id", F.coalesce("payload", F.encode("content", "UTF-8")).alias("payload"))


def current(frames: DataFrame) -> DataFrame:
    """Active frames."""
    return frames.filter(F.col("status") == ACTIVE)


def lineage(frames: DataFrame) -> DataFrame:
    """Version number from 1, next and previous version of every frame not deleted."""
    kept = frames.filter(F.col("status") != DELETED)
    return kept.withColumn("version", F.row_number().over(_versions())).withColumn("previous_id", F.lag("frame_id").over(_versions())).withColumn("next_id", F.lead("frame_id").over(_versions()))


def under_legal_hold(tags: Column) -> Column:
    return F.exists(tags, lambda t: (t == "legal_hold") | t.startswith("legal_hold:"))


def drop_tombstones(frames: DataFrame) -> DataFrame:
    """Tombstones become deleted, except under legal hold."""
    gone = (F.col("status") == TOMBSTONE) & ~under_legal_hold(F.col("tags"))
    return frames.withColumn("status", F.when(gone, DELETED).otherwise(F.col("status")))


def drop_tombstones_keep(frames: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` tombstones of a document stay; older ones become deleted, except
    under legal hold."""
    newest = Window.partitionBy("doc_id", "status").orderBy(F.col("created_at").desc(), F.col("frame_id").desc())
    ranked = frames.withColumn("__rank", F.row_number().over(newest))
    gone = (F.col("status") == TOMBSTONE) & (F.col("__rank") > keep) & ~under_legal_hold(F.col("tags"))
    return ranked.withColumn("status", F.when(gone, DELETED).otherwise(F.col("status"))).drop("__rank")


def delete(frames: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Recoverable delete: active frames of the documents named become tombstones."""
    named = doc_ids.select(F.col("doc_id").alias("__named")).distinct()
    joined = frames.join(named, frames.doc_id == named["__named"], "left")
    hit = F.col("__named").isNotNull() & (F.col("status") == ACTIVE)
    return joined.withColumn("status", F.when(hit, TOMBSTONE).otherwise(F.col("status"))).drop("__named")


def deletable_by_age(frames: DataFrame, before: str, tag: str | None = None) -> DataFrame:
    """Active frames created before a date, with a tag if one is given (a dry run's list)."""
    found = current(frames).filter(F.col("created_at") < F.lit(before).cast("timestamp"))
    return found.filter(F.array_contains("tags", tag)) if tag else found


def restore_latest(frames: DataFrame) -> DataFrame:
    """Of each document the newest tombstone becomes active and the active one a tombstone."""
    newest = Window.partitionBy("doc_id", "status").orderBy(F.col("created_at").desc(), F.col("frame_id").desc())
    ranked = frames.withColumn("__rank", F.row_number().over(newest))
    any_tombstone = F.max((F.col("status") == TOMBSTONE).cast("int")).over(Window.partitionBy("doc_id")) == 1
    state = F.when((F.col("status") == TOMBSTONE) & (F.col("__rank") == 1), ACTIVE).when((F.col("status") == ACTIVE) & any_tombstone, TOMBSTONE).otherwise(F.col("status"))
    return ranked.withColumn("__state", state).drop("__rank", "status").withColumnRenamed("__state", "status")


def checkout(frames: DataFrame, frame_id: int, new_id: int, at: str) -> DataFrame:
    """An old version's content as a new head that inherits its tags."""
    old = frames.filter(F.col("frame_id") == frame_id)
    return put(frames, old.withColumn("frame_id", F.lit(new_id).cast("long")).withColumn("created_at", F.lit(at).cast("timestamp")))


def add_tag(frames: DataFrame, tag: str, where: Column | None = None) -> DataFrame:
    hit = (F.col("status") == ACTIVE) if where is None else where
    return frames.withColumn("tags", F.when(hit, F.array_union("tags", F.array(F.lit(tag)))).otherwise(F.col("tags")))


def hold(frames: DataFrame, doc_id: str, case: str) -> DataFrame:
    """Put every version of a document under legal hold."""
    return add_tag(frames, f"legal_hold:{case}", F.col("doc_id") == doc_id)


def release(frames: DataFrame, doc_id: str, case: str) -> DataFrame:
    return frames.withColumn("tags", F.when(F.col("doc_id") == doc_id, F.array_remove("tags", f"legal_hold:{case}")).otherwise(F.col("tags")))


def set_pillar(frames: DataFrame, frame_id: int, pillar: str) -> DataFrame:
    return frames.withColumn("pillar", F.when(F.col("frame_id") == frame_id, pillar).otherwise(F.col("pillar")))


def mark_deleted(frames: DataFrame, frame_id: int) -> DataFrame:
    hit = (F.col("frame_id") == frame_id) & ~under_legal_hold(F.col("tags"))
    return frames.withColumn("status", F.when(hit, DELETED).otherwise(F.col("status")))


def forget_document(frames: DataFrame, base: str) -> DataFrame:
    """All paragraph frames of a file, and frames with its title, become tombstones."""
    hit = (F.col("status") == ACTIVE) & (F.col("doc_id").startswith(f"{base}::") | F.coalesce(F.col("title") == base, F.lit(False)))
    return frames.withColumn("status", F.when(hit, TOMBSTONE).otherwise(F.col("status")))


def orphans(frames: DataFrame, files: DataFrame) -> DataFrame:
    """Active frames whose file part is not listed any more."""
    return current(frames).withColumn("file", F.split_part("doc_id", F.lit("::"), F.lit(1))).join(files.select("file").distinct(), "file", "left_anti")


def not_ingested(new: DataFrame, frames: DataFrame, content: str = "text") -> DataFrame:
    """Rows whose content is not in the store yet, by hash."""
    return new.withColumn("checksum", F.sha2(content, 256)).join(frames.select(F.sha2("content", 256).alias("checksum")).distinct(), "checksum", "left_anti")


def verified(frames: DataFrame) -> DataFrame:
    """``ok``: whether the stored checksum is that of the content."""
    return frames.withColumn("ok", F.col("checksum").eqNullSafe(F.sha2("content", 256)))


def encrypted(frames: DataFrame, key: str) -> DataFrame:
    """Content as AES-GCM ciphertext in ``payload``; the key has 16, 24 or 32 characters."""
    return frames.withColumn("payload", F.aes_encrypt(F.col("content"), F.lit(key), F.lit("GCM"))).withColumn("content", F.lit(None).cast("string"))


def decrypted(frames: DataFrame, key: str) -> DataFrame:
    return frames.withColumn("content", F.aes_decrypt(F.col("payload"), F.lit(key), F.lit("GCM")).cast("string"))


def with_all_tags(frames: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Active frames that have every tag; no tags, no filter."""
    found = current(frames)
    return found.filter(F.size(F.array_except(F.array(*map(F.lit, tags)), F.col("tags"))) == 0) if tags else found


def in_project(frames: DataFrame, project: str) -> DataFrame:
    """Frames of the project and frames of no project."""
    untagged = ~F.exists("tags", lambda t: t.startswith("project:"))
    return frames.filter(untagged | F.array_contains("tags", f"project:{project}"))


def tag_counts(frames: DataFrame, prefix: str = "") -> DataFrame:
    """Tags of active frames with their counts; ``prefix`` of ``link:`` gives the concepts."""
    tags = current(frames).select(F.explode("tags").alias("tag")).filter(F.col("tag").startswith(prefix))
    return tags.groupBy("tag").agg(F.count("*").alias("n"))


def store_stats(frames: DataFrame) -> DataFrame:
    size = F.octet_length("content").cast("long")
    return frames.agg(
        F.count("*").alias("frames"),
        F.count_if(F.col("status") == ACTIVE).alias("active"),
        F.count_if(F.col("status") == TOMBSTONE).alias("tombstones"),
        F.sum(size).alias("bytes"),
        F.sum(F.when(F.col("status") == TOMBSTONE, size).otherwise(0)).alias("tombstone_bytes"),
    )


def segments(rows: DataFrame) -> DataFrame:
    """Documents of ``base::part`` ids: parts and first title."""
    base = rows.withColumn("base", F.split_part("doc_id", F.lit("::"), F.lit(1)))
    return base.groupBy("base").agg(F.min_by("title", "doc_id").alias("title"), F.count("*").alias("n_segments"))


def latest_per_key(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """The last value of each key and how many there were: the head of a chain of notes."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value), F.count("*").alias("n"))


def chained(rows: DataFrame, key: str, *fields: str, order: str = "seq") -> DataFrame:
    """A hash chain per key: each hash covers the hash before and the row's fields."""
    line = F.concat_ws("|", *[F.col(f).cast("string") for f in fields])
    return ordered.chained(rows.withColumn("chain_line", line), key, "chain_line", order)


def chain_breaks(entries: DataFrame, key: str, *fields: str, order: str = "seq") -> DataFrame:
    """Rows of a stored chain whose hash does not follow from the row before; in parallel."""
    line = F.concat_ws("|", *[F.col(f).cast("string") for f in fields])
    before = F.coalesce(F.lag("hash").over(Window.partitionBy(key).orderBy(order)), F.lit(""))
    return entries.withColumn("ok", F.col("hash") == F.sha2(F.concat_ws("|", before, line), 256)).filter(~F.col("ok"))


def snapshot(frames: DataFrame, tag: str, path: str) -> None:
    """A module's active frames as a store of their own."""
    from ..sources.frames import save

    save(with_all_tags(frames, [tag]), path, "overwrite")


def for_language(fixes: DataFrame, language: str) -> DataFrame:
    """Fixes of a language and of none; a tag decides over the body's and the edits' language."""
    own = F.coalesce("tag_lang", "body_lang", "edits_lang")
    return fixes.filter(own.isNull() | (F.lower(own) == language.lower()))
