"""Operator 11: exact duplicates by skew-safe combining, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnesis.llm.common import Scratch

SALTS = 64  # the bits of the mask that says which salts a digest has


def normal(text: Column) -> Column:
    """The text with each run of ASCII white space as one blank; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _read(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """doc_id, the normalised text, its digest and the row's salt."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal(F.col("text")).alias("body"))
    return rows.select("*", digest(F.col("body")).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))


def distinct_texts(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each distinct text: digest, body (the normalised text), keep_id, group_size and mask (bits of the salts that its rows have).

    Each task combines its own rows; then the rows of a (digest, salt) meet, and at last, of each salt one, those of a digest. Texts are grouped by their whole
    content at each of these, the digest only says where they meet: two texts of one digest stay two.
    """
    local = _read(docs, digest).groupBy("digest", "salt", "body").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # no partial sums before this exchange: the rows of a digest are one for each salt and text already
    winners = local.select("digest", "body", "keep_id", "group_size", F.expr("shiftleft(1L, salt)").alias("mask")).repartition("digest")
    return winners.groupBy("digest", "body").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.expr("bit_or(mask)").alias("mask"))


def _give_back(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """rows (doc_id, salt, keys, n) with their group's keep_id and group_size: a group is repeated for each salt that it has, so that a hot one's rows stay apart."""
    salts = F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("mask", i) == 1))
    return rows.join(groups.select(*keys, "keep_id", "group_size", salts.alias("salt")), [*keys, "salt"])


def exact_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each document: doc_id, keep_id (of equal texts, the smallest doc_id), group_size, kept and digest.

    Texts are equal when they are so after each run of ASCII white space became one blank; a null text is an empty one, and nothing else is trimmed. One row of a
    group is kept: of rows that share the smallest doc_id, any one. A null doc_id comes after all others: its row is kept only if the whole group has none, and then
    keep_id is null. An empty table gives no rows. Other columns are ignored.

    Scale: texts are shuffled by (digest, salt) after each task has dropped its own copies, and once more by digest, at most a row for each salt of a text, so that
    no group, however large, meets in a task. Documents then get their group's winner by (digest, salt) without their texts. Digests that stand for two texts are
    looked for, and their documents, if any, joined by whole content.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    by_digest = distinct_texts(docs, digest).groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.expr("bit_or(mask)").alias("mask"))
    groups = scratch.save(by_digest, "groups")
    plain, shared = groups.where("texts = 1"), groups.where("texts > 1").select("digest")
    # copies of one (doc_id, text) go as one row and a count; of them one at most is kept
    counted = lambda rows, *keys: rows.groupBy("doc_id", "salt", *keys).agg(F.count(F.lit(1)).alias("n"))
    out = _give_back(counted(_read(docs, digest), "digest"), plain, ["digest"]).select("doc_id", "keep_id", "group_size", "digest", "n")
    if not shared.isEmpty():
        rows = counted(_read(docs, digest).join(shared, "digest", "left_semi"), "digest", "body")
        texts = distinct_texts(docs, digest).join(shared, "digest", "left_semi")
        out = out.unionByName(_give_back(rows, texts, ["digest", "body"]).select("doc_id", "keep_id", "group_size", "digest", "n"))
    times = F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("time")
    return out.select("*", times).select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("time") == 1)).alias("kept"), "digest")
