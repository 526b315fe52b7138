"""Operator 13: a Merkle manifest of a dataset, with proofs, by merging sparse forests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnesis.llm.common import Scratch, shuffle_partitions
from mnesis.llm.ordering import numbered

ARITY = 16
TOP = -1  # the tree over the sources' roots
Node = tuple[str, int, int]  # digest; first and end of the leaves below it, by position in the whole order
Key = tuple[int, int, int]  # tree, level, index


def digest_of(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Forest:
    """Unresolved nodes of some trees by (tree, level, index). Merging is union, and each run of siblings that is whole becomes its parent: it is associative and
    commutative, as what a run becomes depends on its nodes alone.

    leaves: of each tree that has a node here, how many leaves it has: it says how many siblings a run has. What resolves is noted in `runs`.
    """

    def __init__(self, sources: int):
        self.nodes: dict[Key, Node] = {}
        self.leaves: dict[int, int] = {TOP: sources}
        self.runs: dict[Key, list[Node]] = {}

    def width(self, tree: int, level: int) -> int:
        n = self.leaves[tree]
        for _ in range(level):
            n = -(-n // ARITY)
        return n

    def add(self, tree: int, level: int, index: int, node: Node) -> None:
        """Put a node in and resolve what it completes, up to the last root."""
        while True:
            width = self.width(tree, level)
            if width == 1:
                if tree == TOP:
                    self.nodes[(TOP, level, 0)] = node
                    return
                self.leaves.pop(tree, None)
                tree, level, index = TOP, 0, tree
                continue
            self.nodes[(tree, level, index)] = node
            run = index // ARITY
            keys = [(tree, level, i) for i in range(run * ARITY, min(width, (run + 1) * ARITY))]
            if not all(k in self.nodes for k in keys):
                return
            siblings = [self.nodes.pop(k) for k in keys]
            self.runs[(tree, level, run)] = siblings
            node = (digest_of([s[0] for s in siblings]), siblings[0][1], siblings[-1][2])
            level, index = level + 1, run

    def fold(self, tree: int, index: int, leaf: str, memo: dict) -> tuple[str, str, str]:
        """Of a leaf: its source's root, the proof (digest of all siblings up to the root) and the root, all from the runs known."""
        proof, level, own, subroot = [], 0, leaf, None
        while True:
            width = self.width(tree, level)
            if width == 1:
                if tree == TOP:
                    return subroot, digest_of(proof), own
                subroot, tree, level, index = own, TOP, 0, tree
                continue
            at = (tree, level, index, own)
            if at not in memo:
                run = [s[0] for s in self.runs[(tree, level, index // ARITY)]]
                j = index % ARITY
                memo[at] = "".join(run[:j] + run[j + 1 :]), digest_of([*run[:j], own, *run[j + 1 :]])
            others, own = memo[at]
            proof.append(others)
            level, index = level + 1, index // ARITY


def field(value: Column) -> Column:
    """A value as the leaf has it: `-` for null, else the UTF-8 bytes' count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(text: Column) -> Column:
    parts = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    return F.sha2(F.concat(*map(field, parts)).cast("binary"), 256)


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, source, leaf, and the leaf of the tampered text where that is another one."""
    small = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cast = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"), "text")
    return cast.select("doc_id", "source", leaf_of(F.col("text")).alias("leaf"), F.when(F.coalesce(tampered, F.lit(False)) & (small != F.col("text")), leaf_of(small)).alias("other"))


def _merge(rows: DataFrame, group: str, sources: int) -> DataFrame:
    """For each value of `group`, whose rows are together and nodes: the nodes still open (done = false) and the runs that were completed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, forest = None, Forest(sources)

        def close() -> Iterator[pa.RecordBatch]:
            out = [{"g": held, "done": False, "tree": t, "leaves": forest.leaves[t], "level": lv, "idx": i, "digests": [n[0]], "lo": n[1], "hi": n[2]} for (t, lv, i), n in forest.nodes.items()]
            out += [{"g": held, "done": True, "tree": t, "leaves": 0, "level": lv, "idx": i, "digests": [n[0] for n in s], "lo": s[0][1], "hi": s[-1][2]} for (t, lv, i), s in forest.runs.items()]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in (group, "tree", "leaves", "level", "idx", "digest", "lo", "hi"))
            for g, tree, n, level, idx, digest, lo, hi in zip(*columns, strict=True):
                if g != held:
                    yield from close()
                    held, forest = g, Forest(sources)
                if tree != TOP:
                    forest.leaves[tree] = n
                forest.add(tree, level, idx, (digest, lo, hi))
        yield from close()

    schema = pa.schema([("g", pa.int64()), ("done", pa.bool_()), ("tree", pa.int64()), ("leaves", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digests", pa.list_(pa.string())), ("lo", pa.int64()), ("hi", pa.int64())])
    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), group).sortWithinPartitions(group, "lo")
    return dealt.mapInArrow(run, "g long, done boolean, tree long, leaves long, level int, idx long, digests array<string>, lo long, hi long")


def _proofs(rows: DataFrame, sources: int) -> DataFrame:
    """Rows of each chunk, the runs that reach out of it before its leaves: what the chunk resolves by itself is resolved again, then each leaf is folded twice."""
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, forest, own = None, Forest(sources), []

        def close() -> Iterator[pa.RecordBatch]:
            memo, out, known = {}, [], dict.fromkeys([TOP], sources)
            known.update((r[0], r[1]) for r in own)
            forest.leaves = known
            for tree, _, idx, doc_id, leaf, other in own:
                subroot, proof, root = forest.fold(tree, idx, leaf, memo)
                folded = forest.fold(tree, idx, other, memo)[2] if other is not None else root
                out.append((doc_id, leaf, subroot, root, proof, folded))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("chunk", "level", "tree", "leaves", "idx", "lo", "hi", "doc_id", "leaf", "other", "digests"))
            for chunk, level, tree, n, idx, lo, hi, doc_id, leaf, other, digests in zip(*columns, strict=True):
                if chunk != held:
                    yield from close()
                    held, forest, own = chunk, Forest(sources), []
                if digests is not None:
                    forest.runs[(tree, level, idx)] = [(d, lo, hi) for d in digests]
                    continue
                forest.leaves[tree] = n
                own.append((tree, n, idx, doc_id, leaf, other))
                forest.add(tree, 0, idx, (leaf, lo, lo + 1))
        yield from close()

    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "chunk").sortWithinPartitions("chunk", F.col("digests").isNull(), "lo")
    return dealt.mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")


def manifest(docs: DataFrame, tampered: Column | None = None, chunk: int = 2048, fan: int = 16) -> DataFrame:
    """Per document: doc_id, leaf, subroot (of its source), root, proof_sha256 (over all siblings from its run up to the root), folded_root, verified.

    A leaf is the hash of doc_id, source, lang, n_chars and text, nulls told from empty values. The leaves of a source in order of doc_id (null first; rows of one
    doc_id in order of their leaves) are hashed by sixteens, and so on until one is left; then the sources' roots likewise, in order of source (null first, by UTF-8
    bytes). A lone leaf is its source's root. Of documents for which `tampered` holds, A-Z in the text are lower-cased before the leaf is folded back into a root with
    the siblings as they were; verified tells whether that is the root. A null condition is false. An empty table gives no rows. Other columns are ignored.

    Method: leaves get positions in the whole order, and each chunk of them becomes a sparse forest: nodes by (tree, level, index) whose run of siblings is not whole
    yet, some 15 on either side for each level. Forests merge by `fan` neighbours a round, each run becoming its parent when its last sibling comes; how many siblings
    a run has is known from the counts of leaves. This is a tree reduction in which neighbours meet, other than in RDD.treeReduce, which merges every k-th partition:
    those would share no run, and the open nodes would pile up for the driver. Each round's runs go back to the chunks that have leaves below them, a few for each
    level, so that proofs are made chunk by chunk. The driver sees two counts and no digest.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "manifest")
    each = leaves(docs, F.lit(False) if tampered is None else tampered)
    ordered = numbered(each, [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf"], scratch, "ordered")
    counts = ordered.groupBy("source").agg(F.min("position").alias("start"), F.count(F.lit(1)).alias("leaves"))
    trees = scratch.save(numbered(counts, ["start"], scratch, "sources", "tree").select("tree", "start", "leaves", F.xxhash64("source").alias("k"), F.col("source").alias("s")), "trees")
    sources = trees.count()
    rows = ordered.withColumn("k", F.xxhash64("source")).join(trees, "k").where(F.col("source").eqNullSafe(F.col("s")))
    rows = rows.select(F.expr(f"position div {chunk}").alias("chunk"), "tree", "leaves", (F.col("position") - F.col("start")).alias("idx"), F.col("position").alias("lo"), "doc_id", "leaf", "other")
    rows = scratch.save(rows, "rows")
    last = rows.agg(F.max("chunk")).first()[0]
    groups, k = (-1 if last is None else last) + 1, 0
    opened = rows.select("chunk", "tree", "leaves", F.lit(0).alias("level"), "idx", F.col("leaf").alias("digest"), "lo", (F.col("lo") + 1).alias("hi"))
    key, shared = "chunk", None
    while groups:
        merged = _merge(opened, key, sources)
        merged = scratch.save(merged if k else merged.where("NOT done"), f"merged-{k}")
        if k:  # what a chunk resolves by itself it can resolve again
            done = merged.where("done").select("tree", "level", "idx", "digests", "lo", "hi")
            shared = done if shared is None else shared.unionByName(done)
        if groups == 1:
            break
        groups, k, key = -(-groups // fan), k + 1, "g"
        opened = merged.where("NOT done").select(F.expr(f"g div {fan}").alias("g"), "tree", "leaves", "level", "idx", F.col("digests")[0].alias("digest"), "lo", "hi")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("leaf", "string"), ("other", "string"))]
    both = rows.select("chunk", F.lit(0).alias("level"), "tree", "leaves", "idx", "lo", (F.col("lo") + 1).alias("hi"), "doc_id", "leaf", "other", F.lit(None).cast("array<string>").alias("digests"))
    if shared is not None:
        reach = F.explode(F.sequence(F.expr(f"lo div {chunk}"), F.expr(f"(hi - 1) div {chunk}"))).alias("chunk")
        both = both.unionByName(shared.select(reach, "level", "tree", F.lit(0).cast("long").alias("leaves"), "idx", "lo", "hi", *none, "digests"))
    return _proofs(both, sources).withColumn("verified", F.col("folded_root") == F.col("root"))
