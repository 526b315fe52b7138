"""Operator 1: mix sources to target weights by a low-discrepancy schedule over equal-token blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnesis.llm.common import WORD_PATTERN, Scratch

GOLDEN = 2654435769  # 2**32 divided by the golden ratio, odd


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def water_fill(sizes: Sequence[int], weights: Sequence[float], most: float) -> list[float]:
    """Targets that share sum(sizes) by weight; none is above most times its size, and the excess is shared by weight among the rest."""
    total, caps = sum(sizes), [most * s for s in sizes]
    out, spent = [0.0] * len(sizes), 0.0
    order = sorted(range(len(sizes)), key=lambda i: caps[i] / weights[i])
    left = sum(weights)
    for i in order:
        level = (total - spent) / left
        if caps[i] > level * weights[i]:
            break
        out[i] = float(caps[i])
        spent, left = spent + caps[i], left - weights[i]
        order = order[1:]
    for i in order:
        out[i] = level * weights[i]
    return out


def schedule(targets: Sequence[float], block: int) -> tuple[np.ndarray, np.ndarray]:
    """Source and rank within its source of each slot: golden-ratio points go through the cumulative targets. Each source gets about target / block slots, spread evenly."""
    cumulative = np.cumsum(np.asarray(targets, float))
    total = float(cumulative[-1]) if len(cumulative) else 0.0
    n = math.ceil(total / block)
    points = (np.arange(n, dtype=np.uint64) * np.uint64(GOLDEN) % np.uint64(1 << 32)).astype(float) / 2.0**32 * total
    source = np.minimum(np.searchsorted(cumulative, points, "right"), max(0, len(targets) - 1)).astype(np.int32)
    by_source = np.argsort(source, kind="stable")
    rank = np.empty(n, np.int64)
    counts = np.bincount(source, minlength=len(targets))
    rank[by_source] = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    return source, rank


def block_size(targets: Sequence[float], slots: int, finest: int = 64) -> int:
    """Words of a block: about `slots` blocks in all, and up to eight times as many if the least target would else have fewer than `finest`."""
    total, least = sum(targets), min((t for t in targets if t > 0), default=1.0)
    return max(1, math.ceil(total / (8 * slots)), min(math.ceil(total / slots), int(least / finest)))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most_repeats: int = 3, slots: int = 1 << 18, seed: int = 1, max_sources: int = 1_000_000) -> DataFrame:
    """How many words of each document a mix takes: doc_id, source, size, source_size, target, taken and first_slot (null: not taken).

    Sources sorted by code point (null last) weigh `weights`, repeated in turn, and share the words of all documents; no target is above most_repeats
    times its source's size. The mix is a schedule of slots for blocks of equally many words (see block_size). Golden-ratio points say whose each slot is, and the
    r-th slot of a source takes the r-th block of its documents in a shuffled order, starting anew when they end. So a source's words are its slots' blocks: its
    target but for a few blocks, as many as the points' discrepancy, and at most most_repeats times its size, where its last slots stay short.

    A null or blank text has size 0 and takes no part (taken 0). Repeated rows are documents of their own. A null doc_id or source is a value like any
    other. An empty table gives no rows. Other columns are ignored. Per-source sums come to the driver: above max_sources that is an error.

    Scale: texts are read once for their sizes and hashes; only ids and numbers are shuffled. A source is cut by a hash of id and text into many buckets that are sorted
    apart, so that neither a source nor an id that a third of the rows have is one task's burden. The schedule has a bounded size, and each task computes its part of it.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("h"))
    sized = scratch.save(sized, "sized")
    sums = sized.groupBy("source").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).limit(max_sources + 1).collect()
    if len(sums) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sums.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [int(r.s) for r in sums]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sums))], most_repeats) if sum(sizes) else [0.0] * len(sums)
    block = block_size(targets, slots)
    given = np.bincount(schedule(targets, block)[0], minlength=len(sums))
    limits = [min(int(n) * block, most_repeats * s) for n, s in zip(given, sizes, strict=True)]
    buckets = max(256, sum(r.n for r in sums) // 100_000)

    rows = [(r.source, i, sizes[i], targets[i], limits[i]) for i, r in enumerate(sums)]
    about = spark.createDataFrame(rows, "src string, source_ix int, source_size long, target double, take long")
    doc = sized.join(about, F.col("source").eqNullSafe(F.col("src"))).withColumn("bucket", F.pmod(F.shiftright("h", 8), F.lit(buckets)))
    at = Window.partitionBy("source_ix").orderBy("bucket")
    ahead = doc.groupBy("source_ix", "bucket").agg(F.sum("size").alias("words")).select("source_ix", "bucket", (F.sum("words").over(at) - F.col("words")).alias("ahead"))
    inside = Window.partitionBy("source_ix", "bucket").orderBy("h", "doc_id", "size")
    placed = (
        doc.join(ahead, ["source_ix", "bucket"])
        .withColumn("row", F.row_number().over(inside))
        .withColumn("start", F.col("ahead") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    )
    # The parts of each pass over a source (epoch) that lie in the same block of its words.
    epochs = F.when((F.col("size") > 0) & (F.col("take") > F.col("start")), F.expr("sequence(0L, (take - start - 1) div source_size)"))
    parts = placed.withColumn("epoch", F.explode_outer(epochs)).withColumn("from", F.col("start") + F.col("epoch") * F.col("source_size")).withColumn("to", F.least(F.col("from") + F.col("size"), F.col("take")))
    parts = parts.withColumn("rank", F.explode_outer(F.when(F.col("epoch").isNotNull(), F.expr(f"sequence(`from` div {block}, (`to` - 1) div {block})"))))

    chunks = 8

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, rank = schedule(targets, block)
        for batch in batches:
            for c in batch.column(0).to_numpy():
                i = np.arange(c * len(source) // chunks, (c + 1) * len(source) // chunks)
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(source[i]), pa.array(rank[i])], names=["slot", "source_ix", "rank"])

    dealt = spark.range(0, chunks, 1, chunks).mapInArrow(deal, "slot long, source_ix int, rank long").hint("shuffle_hash")
    key = ["source_ix", "bucket", "row", "doc_id", "source", "size", "source_size", "target"]
    words = F.least(F.col("to"), (F.col("rank") + 1) * block) - F.greatest(F.col("from"), F.col("rank") * block)
    got = parts.join(dealt, ["source_ix", "rank"], "left").groupBy(*key).agg(F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), words)), F.lit(0)).cast("long").alias("taken"), F.min("slot").alias("first_slot"))
    return got.select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot")
