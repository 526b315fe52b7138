"""Exact cosine-threshold joins in cells around pivots, and the sequential rule of a batch over them in rounds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnesis.functions.columns import current, days, lookup
from mnesis.model import DEFAULT, Params
from mnesis.operators.writes import cut, greedy_semantic

_PUT = "bank string, cell int, part int, side int, id long, state int, least double, v array<double>"
_GOT = "id long, cos double, other long, state int, kept boolean, open boolean"


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as one matrix, of unit rows (or zero ones), without a Python object for each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    norm = np.linalg.norm(flat, axis=1, keepdims=True)
    return np.divide(flat, norm, out=np.zeros_like(flat), where=norm > 0)


def threshold(p: Params = DEFAULT, least: float | None = None) -> Column:
    """The cosine from which two texts of a bank are one."""
    return F.lit(float(least)) if least is not None else lookup(F.col("bank"), p.dedup_bank_cosine, p.dedup_cosine)


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose embedding is there and holds no null, no infinity and not only zeros: others are similar to none."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(math.inf)))
    return rows.where(F.col("bank").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine & F.exists("embedding", lambda x: x != 0))


def choose_pivots(rows: DataFrame, n: int) -> np.ndarray:
    """Up to n rows' vectors, the first by a hash of their ids: they steer how much is compared, not what is found."""
    got = rows.select("embedding", F.xxhash64("id").alias("h")).orderBy("h").limit(n).select("embedding").collect()
    return np.array([r.embedding for r in got], float)


def _dealt(rows: DataFrame, side: int, pivots: np.ndarray, parts: dict[tuple[str, int], int]) -> DataFrame:
    """Rows by cell. Side 0 goes to the cell of its nearest pivot, there to one of the cell's parts; side 1 to all parts of every cell that may hold a row within reach.

    Unit vectors of cosine c are d = sqrt(2 - 2c) apart. If y lies within d of x, and y's nearest pivot is p, then |x p| <= |x q| + 2d for x's nearest pivot q: two
    triangles. Cells beyond that hold no match.
    """
    unit = pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column("embedding"))
            far = np.sqrt(np.maximum(0, 2 - 2 * v @ unit.T))
            bank, ids = batch.column("bank").to_pylist(), batch.column("id").to_numpy()
            if side:
                reach = 2 * np.sqrt(np.maximum(0, 2 - 2 * (batch.column("least").to_numpy() - 1e-6))) + 1e-6
                row, cell = np.nonzero(far <= far.min(axis=1, keepdims=True) + reach[:, None])
                n = np.array([parts.get((bank[i], int(c)), 0) for i, c in zip(row.tolist(), cell.tolist(), strict=True)], np.int64)
                part = np.concatenate([np.arange(k) for k in n]) if len(n) else n
                row, cell = np.repeat(row, n), np.repeat(cell, n)
            else:
                row, cell = np.arange(len(v)), far.argmin(axis=1)
                part = np.array([int(i) % parts.get((b, int(c)), 1) for i, b, c in zip(ids.tolist(), bank, cell.tolist(), strict=True)], np.int64)
            for k in range(0, len(row), 4096):
                r = row[k : k + 4096]
                one = v[r]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, one.size + 1, one.shape[1], dtype=np.int32)), pa.array(one.ravel()))
                columns = [batch.column("bank").take(pa.array(r)), pa.array(cell[k : k + 4096].astype(np.int32)), pa.array(part[k : k + 4096].astype(np.int32)), pa.array(np.full(len(r), side, np.int32)), pa.array(ids[r]), batch.column("state").take(pa.array(r)), batch.column("least").take(pa.array(r)), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["bank", "cell", "part", "side", "id", "state", "least", "v"])

    return rows.select("id", "bank", F.col("state").cast("int").alias("state"), F.col("least").cast("double").alias("least"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding")).mapInArrow(run, _PUT)


def _compare(dealt: DataFrame, itself: bool) -> DataFrame:
    """For each side 1 row and part: the nearest side 0 row at its threshold (cosines to 6 digits, ties to state, then id), and, of rows with a smaller id, whether one of
    state 1 (kept) and one of state 2 (open) reaches it. Side 0 of a part is held, and side 1 streams by; a row gives one row at most, however many are like it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, whole = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(batch.column("bank").to_pylist(), batch.column("cell").to_pylist(), batch.column("part").to_pylist(), batch.column("side").to_pylist(), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                k, piece = keys[a], batch.slice(a, b - a)
                if k[:3] != key:
                    key, held, whole = k[:3], [], None
                v, ids = matrix(piece.column("v")), piece.column("id").to_numpy()
                if k[3] == 0:
                    held.append((v, ids, piece.column("state").to_numpy()))
                    continue
                if not held:
                    continue
                if whole is None:
                    whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                w, others, states = whole
                cos = np.floor(v @ w.T * 1e6 + 0.5) / 1e6
                hit = cos >= piece.column("least").to_numpy()[:, None]
                before = others[None, :] < ids[:, None]
                if itself:  # both sides are one batch, of which only earlier rows count
                    hit &= before | (states == 0)[None, :]
                best = np.where(hit, cos, -2.0)
                order = np.lexsort((others, states))
                at = order[best[:, order].argmax(axis=1)]
                kept, open_ = (hit & (states == 1)).any(axis=1), (hit & (states == 2)).any(axis=1)
                some = np.flatnonzero(hit.any(axis=1))
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(best[some, at[some]]), pa.array(others[at[some]]), pa.array(states[at[some]].astype(np.int32)), pa.array(kept[some]), pa.array(open_[some])], names=["id", "cos", "other", "state", "kept", "open"])

    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "bank", "cell", "part").sortWithinPartitions("bank", "cell", "part", "side").mapInArrow(run, _GOT)


def similar(left: DataFrame, right: DataFrame, itself: bool = False, pivots: int = 64, most: int = 4096) -> DataFrame:
    """For each left row (id, bank, embedding, least) that a right row (id, bank, embedding, state) of its bank reaches: the nearest (other, its state, cos), kept and open.

    Exact: what a cell's bounds leave out can't reach the threshold. A cell of more than about `most` right rows is dealt over several parts, so that no bank, day or
    group of copies meets in one task. The driver has the pivots and a count for each bank and cell.
    """
    left, right = usable(left).withColumn("state", F.lit(0)), usable(right).withColumn("least", F.lit(1.0))
    steer = choose_pivots(right, pivots)
    if not len(steer):
        return left.sparkSession.createDataFrame([], _GOT)
    counts = _dealt(right, 0, steer, {}).groupBy("bank", "cell").count().collect()  # banks times pivots at most
    parts = {(r.bank, r.cell): -(-r["count"] // most) for r in counts}
    got = _compare(_dealt(right, 0, steer, parts).unionByName(_dealt(left, 1, steer, parts)), itself)
    best = F.min(F.struct((-F.col("cos")).alias("minus"), "state", "other")).alias("m")
    out = got.groupBy("id").agg(best, F.max("kept").alias("kept"), F.max("open").alias("open"))
    return out.select("id", (-F.col("m.minus")).alias("cos"), F.col("m.other").alias("other"), F.col("m.state").alias("state"), "kept", "open")


def _in_order(rows: pa.Table) -> pa.Table:
    """Of a bounded table of one bank's rows, the ids that stay by the sequential rule."""
    rows = rows.sort_by("id")
    v, least, n, stays = matrix(rows.column("embedding")), rows.column("least").to_numpy(), 0, []
    kept = np.zeros_like(v)
    for i in range(len(v)):
        if (np.floor(kept[:n] @ v[i] * 1e6 + 0.5) / 1e6 < least[i]).all():
            kept[n] = v[i]
            n += 1
            stays.append(i)
    return pa.table({"id": rows.column("id").take(pa.array(stays, pa.int64())).cast(pa.int64())})


def greedy(batch: DataFrame, finish: int = 2000, pivots: int = 64, most: int = 4096, size: int = 1024) -> DataFrame:
    """The rows (id, bank, embedding, least) that stay when each is compared with those of its bank that stay before it, by id: the sequential rule, in rounds.

    In a round, rows that an earlier row which stays reaches are out. The first open rows of a bank are always decided, and of rows in no special order most are in a few
    rounds. When no more than `finish` are open, those are decided one by one on the driver. Rows without a usable embedding
    stay. Each round's states are a checkpoint.

    A round decides on the first `size` open rows of each bank one by one, in a task for each bank, as only earlier rows decide on a row; then the other open rows are
    compared with those of them that stay. So all rows meet only what stays, not each other.
    """
    plain = batch.join(usable(batch).select("id"), "id", "left_anti").select("id")
    open_, stays = cut(usable(batch).select("id", "bank", "embedding", "least")), None
    while True:
        left = open_.count()
        if left <= finish:
            break
        place = F.row_number().over(Window.partitionBy("bank").orderBy("id"))
        head = cut(open_.join(open_.select("id", place.alias("n")).where(F.col("n") <= size).select("id"), "id", "left_semi"))
        first = head.select("bank", "id", "least", "embedding").groupBy("bank").applyInArrow(_in_order, "id long")
        new = cut(head.join(first, "id", "left_semi"))
        stays = new if stays is None else stays.unionByName(new)
        rest = open_.join(head.select("id"), "id", "left_anti")
        out = similar(rest, new.withColumn("state", F.lit(1)), True, pivots, most).where("kept")
        open_ = cut(rest.join(out.select("id"), "id", "left_anti"))
    rows = open_.orderBy("id").collect()  # `finish` at most
    last = [i for b in {r.bank for r in rows} for i in greedy_semantic([(r.id, r.embedding) for r in rows if r.bank == b], next(r.least for r in rows if r.bank == b))]
    spark = batch.sparkSession
    parts = [plain, spark.createDataFrame([(i,) for i in last], "id long"), *([stays.select("id")] if stays is not None else [])]
    return reduce(DataFrame.unionByName, parts)


def semantic_gate(batch: DataFrame, known: DataFrame, p: Params = DEFAULT, least: float | None = None, **sizes: int) -> DataFrame:
    """For each item that is one with a known row or an earlier item that stays: item, existing (of a known row) or earlier (of an item), the nearest of all, and cos.

    batch: item (a total order), bank, embedding; known: id, bank, embedding, the rows to compare with. Items with a known match never stay, so that they stop no other.
    """
    rows = cut(batch.select(F.col("item").alias("id"), "bank", "embedding", threshold(p, least).alias("least")))
    sides = {k: v for k, v in sizes.items() if k != "finish"}
    old = cut(similar(rows, known.select("id", "bank", "embedding").withColumn("state", F.lit(0)), **sides).select("id", "cos", F.col("other").alias("existing")))
    fresh = rows.join(old.select("id"), "id", "left_anti")
    stays = cut(greedy(fresh, **sizes))
    gone = rows.join(stays, "id", "left_anti")
    near = similar(gone, rows.join(stays, "id", "left_semi").withColumn("state", F.lit(1)), True, **sides).select("id", F.col("cos").alias("cos2"), F.col("other").alias("earlier"))
    both = gone.select("id").join(old, "id", "left").join(near, "id", "left")
    older = F.col("cos2").isNull() | (F.col("cos") >= F.col("cos2"))
    return both.select(F.col("id").alias("item"), F.when(older, F.col("existing")).alias("existing"), F.when(F.coalesce(~older, F.lit(True)), F.col("earlier")).alias("earlier"), F.when(older, F.col("cos")).otherwise(F.col("cos2")).alias("cos"))


def retain_semantic(result: DataFrame, embedded: DataFrame, known: DataFrame, now: Column, p: Params = DEFAULT, **sizes: int) -> DataFrame:
    """The result of writes.retain() with status semantic for accepted items that say what a known row or an earlier item says; existing is the row, earlier the item.

    embedded: item and embedding; an item without one passes. known: id, bank, embedding, created_at, invalid_at, ttl_state, of which the current, not retired rows of
    the last dedup_days count. Each bank has its threshold."""
    recent = known.where(current() & (F.col("ttl_state") != "retired") & (F.col("created_at") > now - days(F.lit(p.dedup_days))))
    items = result.where("status = 'accepted'").select("item", "bank").join(embedded.select("item", "embedding"), "item")
    same = semantic_gate(items, recent, p, **sizes).select("item", F.col("existing").alias("same"), "earlier", F.lit(True).alias("hit"))
    out = result.join(same, "item", "left")
    return out.withColumns({"status": F.when(F.col("hit"), F.lit("semantic")).otherwise(F.col("status")), "existing": F.coalesce("existing", "same")}).drop("hit", "same")
