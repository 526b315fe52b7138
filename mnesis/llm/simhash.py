"""Operator 10: SimHash near-duplicates, found whole by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnesis.llm.common import WORD_PATTERN, Scratch, byte_slices, mix64, shuffle_partitions, text_buffer
from mnesis.llm.graph import connected_components

BITS = 64


def grams(text: bytes, shingle: int) -> list[bytes]:
    """A text's word shingles, A-Z in lower case, joined by blanks; one with fewer words is one shingle."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        return [joined]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [joined[a:b] for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)]


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; of none: zero."""
    ones = sum((np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(0, len(hashes), 65536)), np.zeros(BITS, np.int64))
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def hashed(parts: list[bytes], seed: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x, seed) for x in parts], np.uint64)


def fingerprint(text: bytes, shingle: int, seed: int = 42) -> int:
    """The SimHash of a text's word shingles, repeats counted, by XXH64."""
    return majority(hashed(grams(text, shingle), seed))


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                raw, offs = text_buffer(part.column("text"))
                text = raw.tobytes()
                out = np.array([fingerprint(text[a:b], shingle) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def covering_masks(bits: list[int], radius: int, seed: int) -> np.ndarray:
    """2**(radius+1) - 1 masks of the given bit positions, so that for any `radius` of the bits some mask has none of them.

    Each bit i has a vector m(i) of radius+1 binary digits, and the mask of a vector v != 0 holds the bits with <m(i), v> = 1 mod 2: for any radius vectors
    there is a v orthogonal to them all. Every vector but 0 is given out in turn (in an order by seed), so that all masks have about half of the bits.
    """
    width = radius + 1
    order = np.argsort(mix64(np.arange(1, 1 << width, dtype=np.uint64) + np.uint64(seed << 20))) + 1
    given = [int(order[k % len(order)]) for k in range(len(bits))]
    return np.array([sum(1 << b for b, m in zip(bits, given, strict=True) if bin(m & v).count("1") % 2) for v in range(1, 1 << width)], np.uint64)


def bucket_forest(fps: np.ndarray, radius: int) -> list[tuple[int, np.ndarray]]:
    """Links (row, rows) that join what the near pairs of one bucket join, and are such pairs themselves: a search from row to row, each compared with those not reached yet."""
    out, left = [], np.arange(len(fps))
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            u = front.pop()
            hit = np.bitwise_count(fps[left] ^ fps[u]) <= radius
            if hit.any():
                out.append((u, left[hit]))
                front.extend(left[hit].tolist())
                left = left[~hit]
    return out


def _links(rows: DataFrame, radius: int, most: int) -> DataFrame:
    """Links (kind 0) from rows (k, node, fp) sorted by k; of a group of over `most` only its k (kind 1). Groups stream by, `most` rows of one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0

        def put(kind: int, k: np.ndarray, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int32)), pa.array(k), pa.array(u), pa.array(v)], names=["kind", "k", "u", "v"])

        def close() -> Iterator[pa.RecordBatch]:
            if size > most:
                yield put(1, *(np.array([x], np.int64) for x in (key, 0, 0)))
            elif size > 1:
                node, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                if found := bucket_forest(fp, radius):
                    v = np.concatenate([x for _, x in found])
                    u = np.repeat([x for x, _ in found], [len(x) for _, x in found])
                    yield put(0, np.full(len(u), key, np.int64), node[u], node[v])

        for batch in batches:
            k, node = batch.column("k").to_numpy(), batch.column("node").to_numpy()
            if not len(k):
                continue
            fp = batch.column("fp").to_numpy().view(np.uint64)
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(k)) + 1, [len(k)]])
            sizes, last = np.diff(bounds), len(bounds) - 2
            inner = np.arange(last + 1)
            inner = (inner > 0) & (inner < last)
            a = bounds[:-1][inner & (sizes == 2)]  # whole groups of two, all at once
            hit = np.bitwise_count(fp[a] ^ fp[a + 1]) <= radius
            if hit.any():
                yield put(0, k[a[hit]], node[a[hit]], node[a[hit] + 1])
            for g in np.flatnonzero(~inner | (sizes > 2)).tolist():
                if k[bounds[g]] != key:
                    yield from close()
                    key, held, size = int(k[bounds[g]]), [], 0
                size += int(sizes[g])
                if size <= most:
                    held.append((node[bounds[g] : bounds[g + 1]], fp[bounds[g] : bounds[g + 1]]))
                else:
                    held = []
        yield from close()

    return rows.mapInArrow(run, "kind int, k long, u long, v long")


def hamming_links(fps: DataFrame, scratch: Scratch, radius: int = 4, most: int = 8192) -> DataFrame:
    """Links (u, v) over rows (node, fp), fp being distinct, that join exactly what all pairs within the radius join.

    A pair within radius agrees on some mask, and so shares that table's bucket. A bucket of over `most` fingerprints is dealt anew by masks of the bits
    that its own mask leaves free, in which all differences lie; about half of them stay free each time, so that soon no bucket can be so large.
    """
    masks = [int(m) for m in covering_masks(list(range(BITS)), radius, 0).view(np.int64)]
    rows = fps.select("*", F.posexplode(F.array(*map(F.lit, masks))).alias("t", "seen")).select(F.xxhash64("t", F.col("fp").bitwiseAND(F.col("seen"))).alias("k"), "seen", "node", "fp")
    links = None
    for level in range(3):
        dealt = rows.select("k", "node", "fp").repartition(shuffle_partitions(scratch.spark), "k").sortWithinPartitions("k")
        got = scratch.save(_links(dealt, radius, most if level < 2 else 1 << BITS), f"links-{level}")
        new = got.where("kind = 0").select("u", "v")
        links = new if links is None else links.unionByName(new)
        hot = got.where("kind = 1").select("k")
        if hot.isEmpty():
            break
        free = [F.lit(int(m)).bitwiseAND(F.bitwise_not("seen")) for m in covering_masks(list(range(BITS)), radius, level + 1).view(np.int64)]
        rows = rows.join(hot, "k", "left_semi").select("*", F.posexplode(F.array(*free)).alias("t", "mask"))
        rows = rows.select(F.xxhash64("k", "t", F.col("fp").bitwiseAND(F.col("mask"))).alias("k"), F.col("seen").bitwiseOR(F.col("mask")).alias("seen"), "node", "fp")
    return links


def _components(each: DataFrame, scratch: Scratch, radius: int) -> DataFrame:
    """node and component_id, the least doc_id of its component, from rows (node, doc_id, fp)."""
    nodes = connected_components(hamming_links(each.drop("doc_id"), scratch, radius), scratch).select(F.col("node").alias("n"), "component")
    named = scratch.save(each.join(nodes, F.col("node") == F.col("n"), "left").select("node", "doc_id", F.coalesce("component", "node").alias("c")), "named")
    least = named.groupBy("c").agg(F.min("doc_id").alias("component_id")).select(F.xxhash64("c").alias("k"), F.col("c").alias("c2"), "component_id")
    return scratch.save(named.withColumn("k", F.xxhash64("c")).join(least, "k").where("c = c2").select("node", "component_id"), "components")


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id that is reachable by links of at most radius bits.

    Texts are taken with A-Z in lower case and split at ASCII white space. A text with fewer words than a shingle is one shingle; a null or blank one has
    fingerprint zero and is linked like any other. Rows with the same doc_id keep their own fingerprints; a null doc_id takes part, but names a component
    only if it has no other. An empty table gives no rows. Other columns are ignored.

    Scale: the text is read once; all that follows is about distinct fingerprints, so copies cost nothing. Each of those goes to 31 tables (radius 4).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    marked = scratch.save(fingerprints(docs, shingle), "fingerprints")
    each = scratch.save(marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).select(F.col("fp").alias("node"), "doc_id", "fp"), "distinct")
    of_fp = _components(each, scratch, radius)
    scratch.keep("fingerprints", "components")
    return marked.join(of_fp, F.col("fp") == F.col("node")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
