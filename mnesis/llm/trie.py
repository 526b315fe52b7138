"""Operator 12: the prefix trie of conversations, by preorder intervals and prefix sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnesis.llm.common import WORD_PATTERN, Scratch, shuffle_partitions
from mnesis.llm.ordering import numbered, running_sums, spread_join

BLOCK = 32  # turns of a conversation that are handled in one row
_EMPTY = hashlib.sha256(b"").hexdigest()


def own_turns(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, k (from 1, by turn, null first; turns of one number in the order of their digests), digest of role and text, and the text's words. Rows without a conv_id go."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("s"), F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("words"))
    rows = numbered(rows, ["conv_id", F.col("turn").asc_nulls_first(), "s"], scratch, "turns")
    start = rows.groupBy("conv_id").agg(F.min("position").alias("start"))
    return spread_join(rows, start, "conv_id", "position").select("conv_id", (F.col("position") - F.col("start") + 1).alias("k"), "s", "words")


def with_roots(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Turns (conv_id, i, s, words), i from 1 and without gaps, and for each conversation an empty one at 0."""
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("i"), F.lit("").alias("s"), F.lit(0).cast("long").alias("words"))
    return roots.unionByName(turns.select("conv_id", "i", "s", "words"))


def grafted(own: DataFrame, stride: int = 20, most: int = 4) -> DataFrame:
    """Conversations whose first h turns are those of conversation c - c % stride (all if it has fewer, none if it isn't there), and then their own after their first h;
    h = crc32(decimal c) % most. A conversation that is left without turns has only the root."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % stride).alias("b"))
    base = own.where((F.col("conv_id") % stride == 0) & (F.col("k") < most)).select(F.col("conv_id").alias("b"), "k", "s", "words")
    heads = convs.join(base, "b").where("k <= h").select("conv_id", F.col("k").alias("i"), "s", "words")
    got = convs.join(base.groupBy("b").agg(F.count(F.lit(1)).alias("there")), "b", "left").select("conv_id", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("m"))
    tails = spread_join(own.where(F.col("k") > h), got, "conv_id", "k").select("conv_id", (F.col("k") - F.col("h") + F.col("m")).alias("i"), "s", "words")
    return with_roots(heads.unionByName(tails), convs)


def _blocks(rows: DataFrame, *more: str) -> DataFrame:
    """Rows (conv_id, i, s) by blocks of BLOCK: conv_id, q and items in order."""
    item = F.struct("i", "s", *more)
    return rows.groupBy("conv_id", F.expr(f"i div {BLOCK}").alias("q")).agg(F.array_sort(F.collect_list(item)).alias("items"))


def _joined() -> F.Column:
    return F.array_join(F.transform("items", lambda x: x["s"]), "")


def prefix_ids(blocks: DataFrame, scratch: Scratch, label: str = "ids") -> DataFrame:
    """The blocks with ids: the name of the prefix before the block, then of those up to each item. Names are digests, chained within a block; where a block starts, the
    blocks before it have a name from their own digests in the same way, so that there are as many rounds as the length has digits to the base BLOCK."""
    blocks = scratch.save(blocks, label)
    chained = F.aggregate("items", F.array("before"), lambda ids, x: F.concat(ids, F.array(F.sha2(F.concat(F.element_at(ids, -1), x["s"]).cast("binary"), 256))))
    if (blocks.agg(F.max("q")).first()[0] or 0) == 0:
        return blocks.withColumn("before", F.lit("")).withColumn("ids", chained).drop("before")
    full = blocks.where(F.size("items") == BLOCK).select("conv_id", F.col("q").alias("i"), F.sha2(_joined().cast("binary"), 256).alias("s"))
    above = prefix_ids(_blocks(full), scratch, f"{label}-up").select("conv_id", F.posexplode("ids").alias("j", "after"), F.col("q").alias("b"))
    above = scratch.save(above.where("j > 0").select("conv_id", (F.col("b") * BLOCK + F.col("j") - 1).alias("q"), "after"), f"{label}-ends")
    before = above.select("conv_id", (F.col("q") + 1).alias("q"), F.col("after").alias("before"))
    blocks = blocks.join(before, ["conv_id", "q"], "left").withColumn("before", F.coalesce("before", F.lit(""))).withColumn("ids", chained).drop("before")
    # where a whole block ends, the name is that by which the next one starts
    return blocks.join(above, ["conv_id", "q"], "left").withColumn("ids", F.when(F.col("after").isNull(), F.col("ids")).otherwise(F.concat(F.slice("ids", 1, BLOCK), F.array("after")))).drop("after")


def lexicographic(blocks: DataFrame, scratch: Scratch, label: str = "rank") -> DataFrame:
    """conv_id and rank, 0-based, of distinct sequences in lexicographic order, what is a prefix of another coming first. Blocks get their ranks as names, and sequences of
    names are ranked in turn, until each sequence is one block."""
    keyed = blocks.select("conv_id", "q", _joined().alias("key"))
    if (blocks.agg(F.max("q")).first()[0] or 0) == 0:
        return numbered(keyed.select("conv_id", "key"), ["key"], scratch, label, "rank").drop("key")
    names = numbered(keyed.select("key").distinct(), ["key"], scratch, f"{label}-names", "name")
    names = names.select(F.sha2(F.col("key").cast("binary"), 256).alias("d"), F.lpad(F.hex("name"), 16, "0").alias("s"))
    named = spread_join(keyed.select("conv_id", F.col("q").alias("i"), F.sha2(F.col("key").cast("binary"), 256).alias("d")), names, "d", "conv_id")
    return lexicographic(scratch.save(_blocks(named), f"{label}-up-in"), scratch, f"{label}-up")


def _joined_ids(ends: DataFrame, piece: int) -> DataFrame:
    """id and ends_sha256 of rows (id, conv_id): the digest of the ids in order, comma-joined. Tasks join ranges of them to pieces; a digest is made of pieces streaming by."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [None, 0, []]

        def close() -> Iterator[pa.RecordBatch]:
            if held[2]:
                yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]], pa.int64()), pa.array([",".join(held[2])])], names=["id", "first", "part"])

        for batch in batches:
            for node, conv in zip(batch.column("id").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if node != held[0] or len(held[2]) >= piece:
                    yield from close()
                    held[:] = [node, conv, []]
                held[2].append(str(conv))
        yield from close()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            out: list = []
            for x, part in zip(batch.column("id").to_pylist(), batch.column("part").to_pylist(), strict=True):
                if x == node:
                    digest.update(b",")
                else:
                    if node is not None:
                        out.append((node, digest.hexdigest()))
                    node, digest = x, hashlib.sha256()
                digest.update(part.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["id", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([digest.hexdigest()])], names=["id", "ends_sha256"])

    n = shuffle_partitions(ends.sparkSession)
    parts = ends.repartitionByRange(n, "id", "conv_id").sortWithinPartitions("id", "conv_id").mapInArrow(pieces, "id string, first long, part string")
    return parts.repartition(n, "id").sortWithinPartitions("id", "first").select("id", "part").mapInArrow(digests, "id string, ends_sha256 string")


def prefix_trie(turns: DataFrame, scratch: Scratch, piece: int = 8192) -> DataFrame:
    """The trie of the conversations' turns, rows (conv_id, i, s, words) as with_roots() gives them: a row for each node, that is each distinct sequence of first turns.

    conv_id (smallest member) and depth name a node; parent_conv_id, n_convs (members), n_children, n_leaves (of its subtree), saved_tokens (over its subtree: words of a
    node's last text times members but one), ends_sha256 (of the conv_ids that end at it). No conversation, no row.

    Method: prefixes are named by digests, and equal conversations go on as one. These are ranked lexicographically; a node's subtree is what the conversations from its
    first to its last member add, so that in order of (first rank, depth), which is preorder, it is an interval, from the node to the leaf where its last member ends.
    Leaves and savings of a subtree are differences of running sums over that order. Long conversations are handled by blocks of turns, in rounds.
    """
    named = prefix_ids(_blocks(turns, "words"), scratch).select("conv_id", "q", "items", "ids")
    named = scratch.save(named, "named")
    last = named.groupBy("conv_id").agg(F.max_by(F.element_at("ids", -1), "q").alias("id"))
    last = scratch.save(last, "last")
    same = last.groupBy("id").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("w")).drop("id")
    rows = scratch.save(named.join(same, "conv_id"), "sequences")
    ranks = lexicographic(rows.select("conv_id", "q", "items"), scratch)
    each = rows.join(ranks, "conv_id").select("conv_id", "rank", "w", "ids", F.posexplode("items").alias("j", "x"))
    each = each.select("conv_id", "rank", "w", F.col("x.i").alias("depth"), F.col("x.words").alias("words"), F.expr("ids[j + 1]").alias("id"), F.expr("CASE WHEN x.i > 0 THEN ids[j] END").alias("parent"))
    nodes = each.groupBy("id").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.sum("w").alias("n_convs"), F.min("words").alias("words"), F.min("parent").alias("parent"), F.min("rank").alias("first"), F.max("rank").alias("last"))
    nodes = scratch.save(nodes, "nodes")
    kids = nodes.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).where("parent IS NOT NULL").withColumnRenamed("parent", "id")
    up = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = spread_join(nodes.join(kids, "id", "left").na.fill(0, ["n_children"]), up, "parent", "id", how="left")
    whole = whole.select("*", F.expr("IF(n_children = 0, 1L, 0L)").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")).drop("parent", "words")
    order = running_sums(numbered(whole, ["first", "depth"], scratch, "preorder"), "position", ["leaf", "saved"], scratch, "sums")
    # a leaf is the end of at most depth + 1 subtrees; it comes once for each 1024 of them
    span = 1024
    stop = order.where("leaf = 1").select(F.col("first").alias("last"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"depth div {span}"))).alias("part"), F.col("sum_leaf").alias("to_leaf"), F.col("sum_saved").alias("to_saved"))
    out = order.withColumn("part", F.expr(f"depth div {span}")).join(stop, ["last", "part"])
    out = out.join(_joined_ids(last.select("id", "conv_id"), piece), "id", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("to_leaf") - F.col("sum_leaf") + F.col("leaf")).alias("n_leaves"), (F.col("to_saved") - F.col("sum_saved") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """prefix_trie() of the conversations as they are. A null role or text is an empty one, turns without a conv_id take no part; other columns are ignored."""
    scratch = Scratch(conversations.sparkSession, "trie")
    own = scratch.save(own_turns(conversations, scratch), "own")
    return prefix_trie(with_roots(own.withColumnRenamed("k", "i"), own.select("conv_id").distinct()), scratch)


def grafted_trie(conversations: DataFrame) -> DataFrame:
    """prefix_trie() of the conversations with the heads of others, see grafted()."""
    scratch = Scratch(conversations.sparkSession, "trie")
    own = scratch.save(own_turns(conversations, scratch), "own")
    return prefix_trie(scratch.save(grafted(own), "grafted"), scratch)
