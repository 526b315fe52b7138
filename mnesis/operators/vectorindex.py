"""A vector index: each bank's unit vectors in cells around centres, with an exact search that stops by the cells' radii and a probing one."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnesis.functions.columns import cosine
from mnesis.model import DEFAULT
from mnesis.operators.retrieval import top
from mnesis.operators.similar import matrix, usable

_CELLS = "bank string, cell int, centre array<double>, radius double, n_rows long"


def _units(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _first_centres(rows: DataFrame, cells: int) -> dict[str, np.ndarray]:
    """Up to `cells` vectors of each bank, the first by a hash of their ids; each task sends no more than that."""
    ranked = rows.select("bank", F.struct(F.xxhash64("id").alias("h"), "id", "embedding").alias("x"))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for bank, x in zip(batch.column("bank").to_pylist(), batch.column("x").to_pylist(), strict=True):
                held.setdefault(bank, []).append(x)
                if len(held[bank]) >= 4 * cells:
                    held[bank] = sorted(held[bank], key=lambda r: (r["h"], r["id"]))[:cells]
        out = [{"bank": b, "h": r["h"], "id": r["id"], "v": r["embedding"]} for b, x in held.items() for r in sorted(x, key=lambda r: (r["h"], r["id"]))[:cells]]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("bank", pa.string()), ("h", pa.int64()), ("id", pa.int64()), ("v", pa.list_(pa.float64()))]))

    few = ranked.mapInArrow(least, "bank string, h long, id long, v array<double>")
    got: dict[str, list] = {}
    for r in few.groupBy("bank").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "id", "v"))), 1, cells).alias("x")).collect():  # banks times cells
        got[r.bank] = [y.v for y in r.x]
    return {b: _units(np.array(v, float)) for b, v in got.items()}


def _assigned(rows: DataFrame, centres: dict[str, np.ndarray]) -> DataFrame:
    """id, bank, cell (of the nearest centre), the distance to it and the vector as it came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v, banks = matrix(batch.column("embedding")), np.array(batch.column("bank").to_pylist(), object)
            cell, far = np.zeros(len(v), np.int32), np.zeros(len(v))
            for b in set(banks.tolist()):
                at = np.flatnonzero(banks == b)
                d = np.linalg.norm(v[at][:, None, :] - centres[b][None, :, :], axis=2) if len(at) * centres[b].size < 1 << 22 else np.sqrt(np.maximum(0, (v[at] ** 2).sum(1)[:, None] + (centres[b] ** 2).sum(1) - 2 * v[at] @ centres[b].T))
                cell[at] = d.argmin(1)
                far[at] = np.linalg.norm(v[at] - centres[b][cell[at]], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("bank"), pa.array(cell), pa.array(far), batch.column("embedding")], names=["id", "bank", "cell", "far", "embedding"])

    return rows.select(F.col("id").cast("long").alias("id"), "bank", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")).mapInArrow(run, "id long, bank string, cell int, far double, embedding array<double>")


def vector_index_build(rows: DataFrame, path: str, cells: int = 64, rounds: int = 2) -> None:
    """Write the index of rows (id, bank, embedding): vectors by directories of bank and cell, and the table `cells` with each one's centre, radius and rows.

    Centres start as `cells` vectors of a bank and move to their cells' means `rounds` times: sums by cell and dimension, added up before they are shuffled. Rows without
    a usable embedding are not in the index. The driver has banks times cells centres.
    """
    rows = usable(rows)
    centres = _first_centres(rows, cells)
    for _ in range(rounds):
        placed = _assigned(rows, centres).select("bank", "cell", F.posexplode("embedding").alias("k", "x"), F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)).alias("norm"))
        sums = placed.groupBy("bank", "cell", "k").agg(F.sum(F.col("x") / F.col("norm")).alias("x")).groupBy("bank", "cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda y: y["x"]).alias("x"))
        for r in sums.collect():
            centres[r.bank][r.cell] = _units(np.array([r.x]))[0]
    placed = _assigned(rows, centres)
    placed.repartition("bank", "cell").write.mode("overwrite").partitionBy("bank", "cell").parquet(f"{path}/vectors")
    spark = rows.sparkSession
    sizes = _vectors(spark, path).groupBy("bank", "cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n_rows")).collect()
    table = [(r.bank, r.cell, centres[r.bank][r.cell].tolist(), r.radius, r.n_rows) for r in sizes]
    spark.createDataFrame(table, _CELLS).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def _vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, far double, embedding array<double>, bank string, cell int").parquet(f"{path}/vectors")


def indexed_vector_route(spark: SparkSession, path: str, query: Sequence[float], memories: DataFrame, rows: Column, n: int = DEFAULT.top_vector, bank: str | None = None, first: int = 4, probe: int | None = None) -> tuple[DataFrame, dict[str, int]]:
    """id, rank and score of the n visible rows of greatest cosine (6 digits, ties to the smaller id), and how many cells there are and were read.

    A row of a cell is at least |q c| - radius from the query, so that its cosine is bounded. The `first` cells of the greatest bounds are read; then those whose bound reaches
    the n-th score found: the result is that of a search through all rows. With `probe`, the cells of that many nearest centres are read and no more, which may miss rows.
    """
    known = spark.read.schema(_CELLS).parquet(f"{path}/cells")
    cells = known.where(F.col("bank") == bank).collect() if bank else known.collect()  # banks times cells
    empty = spark.createDataFrame([], "id long, rank int, score double")
    if not cells:
        return empty, {"cells": 0, "read": 0}
    q = _units(np.array([query], float))[0]
    far = np.array([np.linalg.norm(q - np.array(c.centre)) for c in cells])
    gap = np.maximum(0, far - np.array([c.radius for c in cells]) - 1e-9)
    bound = 1 - gap**2 / 2 if q.any() else np.zeros(len(cells))
    order = np.argsort(far if probe else -bound, kind="stable")
    shown = memories.where(rows).select("id")
    unit = F.array(*[F.lit(float(x)) for x in query])

    def search(which: np.ndarray) -> DataFrame:
        names: dict[str, list[int]] = {}
        for i in which.tolist():
            names.setdefault(cells[i].bank, []).append(cells[i].cell)
        of = F.lit(False)
        for b, x in names.items():
            of = of | ((F.col("bank") == b) & F.col("cell").isin(x))
        found = _vectors(spark, path).where(of).join(shown, "id", "left_semi").select("id", F.round(cosine(F.col("embedding"), unit), 6).alias("score"))
        return top(found, n, F.desc("score"), F.asc("id")).select("id", "rank", "score")

    if probe:
        return search(order[:probe]), {"cells": len(cells), "read": min(probe, len(cells))}
    scores = [r.score for r in search(order[:first]).select("score").collect()]
    least = min(scores) if len(scores) == n else -1.0
    read = np.flatnonzero(bound >= least - 2e-6)
    read = np.union1d(read, order[:first])
    return search(read), {"cells": len(cells), "read": len(read)}
