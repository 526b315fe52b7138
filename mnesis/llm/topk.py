"""Operator 7: exact top-k search by inner product, with candidates eliminated by a pivot table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnesis.llm.common import Scratch


def usable(vector: Column) -> Column:
    """Neither null nor with a null, NaN or infinite component."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of a list array as a matrix; shorter ones are filled up with zeros."""
    offs = vectors.offsets.to_numpy().astype(np.int64)
    flat = vectors.values.to_numpy(zero_copy_only=False)[offs[0] : offs[-1]]
    offs = offs - offs[0]
    n = np.diff(offs)
    if len(n) and (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - offs[:-1][row]] = flat
    return out


class PivotTable:
    """Inner products as distances: with one more coordinate, sqrt(reach - |x|^2) for candidates and 0 for queries and pivots, |q - x|^2 = |q|^2 + reach - 2 <q, x>."""

    def __init__(self, pivots: np.ndarray, reach: float):
        self.pivots, self.reach = pivots, reach
        self.square = (pivots**2).sum(1)

    def distances(self, x: np.ndarray, candidates: bool) -> np.ndarray:
        square = (x**2).sum(1)
        d = square[:, None] + self.square - 2 * x @ self.pivots.T
        if candidates:
            d += np.maximum(0, self.reach - square)[:, None]
        return np.sqrt(np.maximum(0, d))

    def upper(self, square: float, to_query: np.ndarray, to_candidates: np.ndarray, use: int) -> np.ndarray:
        """Bounds that a query's inner products with candidates do not exceed: the greatest lower bounds of the distances, turned round.

        to_candidates: (pivots, candidates). The bounds are taken at the `use` pivots nearest to the query, which tell the most.
        """
        nearest = np.argpartition(to_query, use)[:use] if use < len(to_query) else np.arange(len(to_query))
        least = np.zeros(to_candidates.shape[1], np.float32)
        for p in nearest:
            np.maximum(least, np.abs(to_candidates[p] - to_query[p]), out=least)
        least *= np.float32(1 - 1e-5)
        return (square + self.reach - least.astype(float) ** 2) / 2 + 1e-4 * (square + self.reach + 1)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows of a sample in random order, none twice: thus dense regions, where most queries are, have pivots of their own."""
    _, at = np.unique(sample[: 4 * n], axis=0, return_index=True)
    return sample[np.sort(at)[:n]]


def search_block(ids: np.ndarray, queries: np.ndarray, best: list[tuple[np.ndarray, np.ndarray]], table: PivotTable, to_query: np.ndarray, other: np.ndarray, vectors: np.ndarray, k: int, step: int = 256, use: int = 6) -> int:
    """Improve best, each query's top k so far as (scores, ids), by a block of candidates; how many were evaluated.

    For each query, candidates go by falling bound. When the k-th score so far is above the bound of the next ones, none of them can enter.
    """
    to_candidates = np.ascontiguousarray(table.distances(vectors, True).T.astype(np.float32))
    square, evaluated = (queries**2).sum(1), 0
    for q in range(len(ids)):
        score, who = best[q]
        bounds = table.upper(square[q], to_query[q], to_candidates, use)
        alive = np.flatnonzero(bounds >= score[k - 1]) if len(score) >= k else np.arange(len(other))
        if len(alive) > step:
            alive = alive[np.argsort(-bounds[alive])]
        at, size = 0, step
        while at < len(alive) and (len(score) < k or bounds[alive[at]] >= score[k - 1]):
            got = alive[at : at + size]
            at, evaluated, size = at + size, evaluated + len(got), 4 * size
            s = vectors[got] @ queries[q]
            new = other[got] != ids[q]
            if len(score) >= k:
                new &= s >= score[k - 1]
            if new.any():
                score, who = np.concatenate([score, s[new]]), np.concatenate([who, other[got[new]]])
                top = np.lexsort((who, -score))[:k]
                score, who = score[top], who[top]
        best[q] = score, who
    return evaluated


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, pivots: int = 512, sample: int = 4096, query_block: int = 4096, rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id and score: for each query, the k other rows of greatest inner product, ties to the smaller vec_id; all, if there are fewer.

    vectors: vec_id and x, an array of doubles. Rows without an id, with a null x or a null or non-finite component take no part. A shorter vector counts as
    filled up with zeros. Rows that repeat a query's vec_id are its own, and no candidates for it; it is asked once, with its least vector. Other repeated
    rows are candidates each. An empty table gives no rows. Scores are exact while products are (integers as doubles).

    Method: pivots are picked from a bounded sample by hash; each task holds its candidates' distances to them, and evaluates a query's candidates by falling
    bound until none of the rest can enter. The stated query set goes against all rows in blocks of about query_block queries, one job for each block, with
    the block (bounded) in the tasks' closures; each query first gets a floor from the sample, so that tasks return little that is not in the result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    x = F.col("x").cast("array<double>")
    good = vectors.select(F.col("vec_id").cast("long"), x.alias("x"), is_query.alias("asked")).where(F.col("vec_id").isNotNull() & usable(F.col("x")))
    stats = good.agg(F.max(F.size("x")), F.max(F.aggregate("x", F.lit(0.0), lambda a, b: a + b * b)), F.count(F.when(F.col("asked"), 1))).first()
    width, reach, asked = int(stats[0] or 0), float(stats[1] or 0), int(stats[2])
    schema = "query_id long, rank int, vec_id long, score long"
    if not asked:
        return spark.createDataFrame([], schema)
    fill = lambda rows: (np.array([r.vec_id for r in rows], np.int64), np.array([r.x + [0.0] * (width - len(r.x)) for r in rows]).reshape(len(rows), width))
    some_ids, some = fill(good.select("vec_id", "x").orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(sample).collect())
    table = PivotTable(choose_pivots(some, pivots), reach)
    blocks = -(-asked // query_block)
    out = None
    for b in range(blocks):
        block = good.where(F.col("asked") & (F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(blocks)) == b)).groupBy("vec_id").agg(F.min("x").alias("x")).collect()
        ids, queries = fill(sorted(block, key=lambda r: r.vec_id))
        to_query = table.distances(queries, False).astype(np.float32)
        floor = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]
        search_block(ids, queries, floor, table, to_query, some_ids, some, k)
        least = np.array([s[k - 1] if len(s) >= k else -np.inf for s, _ in floor])

        def run(batches: Iterator[pa.RecordBatch], ids=ids, queries=queries, to_query=to_query, least=least) -> Iterator[pa.RecordBatch]:
            # a floor stands for k rows just below it, which are never returned: whatever equals it may still enter
            best = [(np.full(k, np.nextafter(f, -np.inf)), np.full(k, np.iinfo(np.int64).max)) if np.isfinite(f) else (np.zeros(0), np.zeros(0, np.int64)) for f in least]
            for batch in batches:
                for i in range(0, batch.num_rows, rows):
                    part = batch.slice(i, rows)
                    search_block(ids, queries, best, table, to_query, part.column("vec_id").to_numpy(), _matrix(part.column("x"), width), k)
            real = [np.ones(len(w), bool) if not np.isfinite(f) else s >= f for (s, w), f in zip(best, least, strict=True)]
            n = np.array([r.sum() for r in real])
            score = np.concatenate([s[r] for (s, _), r in zip(best, real, strict=True)]) if len(ids) else np.zeros(0)
            who = np.concatenate([w[r] for (_, w), r in zip(best, real, strict=True)]) if len(ids) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(who), pa.array(score.astype(np.int64))], names=["query_id", "vec_id", "score"])

        each = good.select("vec_id", "x").mapInArrow(run, "query_id long, vec_id long, score long")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        got = scratch.save(each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), f"block-{b}")
        out = got if out is None else out.unionByName(got)
    return out
