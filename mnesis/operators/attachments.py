"""Attachments that share their content by its hash: rows that refer to it, and the content, which goes when nothing refers to it any more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnesis.operators.changes import log_rows
from mnesis.sources.commits import Change, Conflict, Store

ATTACHMENT = "id long, memory_id long, content_hash string, mime string, bytes long, state string, created_at timestamp_ntz"
BLOB = "content_hash string, content binary, bytes long, written_at timestamp_ntz"


def create(store: Store, buckets: int = 64) -> None:
    store.create("attachments", store.spark.createDataFrame([], ATTACHMENT), "id", buckets)
    store.create("blobs", store.spark.createDataFrame([], BLOB), "content_hash", buckets)


def uploaded(rows: DataFrame, attachments: DataFrame, blobs: DataFrame, at: Column) -> dict[str, Change]:
    """rows: id, memory_id, content, mime. Of equal content of a memory the upload of least id is taken, unless the memory has it; content that is there isn't written again.
    Blobs are taken anew with the time of this upload, so that a sweep lets them be for its grace."""
    new = rows.where("content IS NOT NULL").withColumns({"content_hash": F.sha2("content", 256), "bytes": F.octet_length("content").cast("long"), "state": F.lit("active"), "created_at": at})
    first = new.groupBy("memory_id", "content_hash").agg(F.min("id").alias("id"))
    had = attachments.where("state <> 'deleted'").select("memory_id", "content_hash")
    kept = new.join(first.join(had, ["memory_id", "content_hash"], "left_anti"), ["id", "memory_id", "content_hash"], "left_semi").select(*attachments.columns)
    one = new.join(kept.select("content_hash"), "content_hash", "left_semi").groupBy("content_hash").agg(F.first("content").alias("content"))
    written = one.select("content_hash", "content", F.octet_length("content").cast("long").alias("bytes"), at.alias("written_at"))
    return {"attachments": Change("append", kept), "blobs": Change("upsert", written)}


def of_memories(attachments: DataFrame, memories: DataFrame, include_deleted: bool = False) -> DataFrame:
    """The attachments of these memories (id), the oldest first."""
    rows = attachments if include_deleted else attachments.where("state <> 'deleted'")
    return rows.join(memories.select(F.col("id").alias("memory_id")), "memory_id", "left_semi").orderBy("memory_id", "created_at", "id")


def deleted(attachments: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows that become deleted; rows and content stay, so that the same content may come again."""
    return attachments.where("state <> 'deleted'").join(ids.select("id").distinct(), "id", "left_semi").withColumn("state", F.lit("deleted"))


def garbage(memories: DataFrame, attachments: DataFrame, blobs: DataFrame, at: Column, grace: str = "1 day") -> tuple[DataFrame, DataFrame]:
    """Attachments (id, memory_id) whose memory is gone, and blobs (content_hash, bytes) that no attachment of a memory refers to, deleted ones included, and that were
    written before the grace. References are counted by hash before they meet the blobs, and content isn't read."""
    orphans = attachments.join(memories.select(F.col("id").alias("memory_id")), "memory_id", "left_anti").select("id", "memory_id")
    marked = attachments.join(memories.select(F.col("id").alias("memory_id")), "memory_id", "left_semi").select("content_hash").distinct()
    old = blobs.where(F.col("written_at") <= at - F.expr(f"INTERVAL {grace}")).select("content_hash", "bytes")
    return orphans, old.join(marked, "content_hash", "left_anti")


def sweep(store: Store, at: Column, grace: str = "1 day", tries: int = 5) -> int:
    """Commit what garbage() finds, with a changelog row for each attachment. An upload that comes between changes attachments too, so that the sweep finds a conflict and marks
    anew: no blob goes that a version refers to."""
    for k in range(tries):
        base = store.version()
        orphans, blobs = garbage(store.read("memories", base), store.read("attachments", base), store.read("blobs", base), at, grace)
        log = log_rows(orphans, "attachment_purge", at, "memory_id", id=F.col("id").cast("string"))
        try:
            return store.commit("sweep", {"attachments": Change("delete", orphans), "blobs": Change("delete", blobs), "changelog": Change("append", log)}, base)
        except Conflict:
            if k == tries - 1:
                raise
    raise ValueError("tries must be positive")
