"""Structured Streaming over the access and feedback logs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mnesis.model import DEFAULT, OUTCOMES, Params
from mnesis.operators import accesslog, changes
from mnesis.operators.lifecycle import scan
from mnesis.sources.commits import Change, Store


def tumbling(access: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Accesses by window and kind; rows later than the watermark are left out. An extra that the model itself does not have."""
    return access.withWatermark("ts", late).groupBy(F.window("ts", width), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "kind", "n")


def sessions(access: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each caller's accesses."""
    return access.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "caller").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), "caller", "n")


def first_queries(queries: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Hard queries without repeats of one key within the time to live, counted from the first sighting."""
    return queries.withWatermark("ts", f"{p.hard_ttl_days} days").dropDuplicatesWithinWatermark(["key"])


def ema_updates(feedback: DataFrame, memories: DataFrame | None = None, p: Params = DEFAULT) -> DataFrame:
    """memory_id, polarity and events after each batch: one number is kept for each memory, whatever its events. Events count in order of seq within a batch; one that comes
    in a later batch counts when it comes, whatever its seq. The first event starts from the polarity that the memory then has (memories: id, polarity), none as 0."""
    a = p.ema_alpha
    if memories is None:
        started = feedback.withColumn("start", F.lit(0.0))
    else:
        started = feedback.join(memories.select(F.col("id").alias("memory_id"), F.coalesce(F.col("polarity").cast("double"), F.lit(0.0)).alias("start")), "memory_id")

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq")
        value, n = state.get if state.exists else (float(rows["start"].iloc[0]), 0)
        for outcome in rows["outcome"]:  # each step is rounded, so that no sum of a batch's events stands for them
            if outcome in OUTCOMES:
                value, n = math.floor((value + a * (OUTCOMES[outcome] - value)) * 1e6 + 0.5) / 1e6, n + 1
        state.update((value, n))
        yield pd.DataFrame({"memory_id": [key[0]], "polarity": [value], "events": [n]})

    return started.groupBy("memory_id").applyInPandasWithState(update, "memory_id long, polarity double, events long", "value double, n long", "update", GroupStateTimeout.NoTimeout)


def life_cycle(access: DataFrame, memories: Callable[[], DataFrame], log: Callable[[DataFrame], DataFrame], commit: Callable[[DataFrame, int], None], now: Callable[[], Column], p: Params = DEFAULT) -> DataStreamWriter:
    """The life-cycle timer: on each trigger of the access stream the rules run over the memories and the log, and commit() gets the rows that move, with the batch's
    number, so that a batch that is repeated can be told. log(batch) returns the log that holds the batch's rows."""

    def run(batch: DataFrame, number: int) -> None:
        commit(scan(memories(), log(batch), now(), p).where("new_state <> ttl_state"), number)

    return access.writeStream.foreachBatch(run)


def life_cycle_of_store(access: DataFrame, store: Store, now: Callable[[], datetime], stream: str = "access", p: Params = DEFAULT) -> DataStreamWriter:
    """The life-cycle timer over a store with memories, changelog and the tables of operators.accesslog: a batch is absorbed, and what the rules then move is committed with its
    log. Of the log, a trigger reads its own rows and one day's, whatever its length; a trigger that is repeated adds nothing and moves what it hadn't moved."""

    def run(batch: DataFrame, number: int) -> None:
        accesslog.absorb(store, batch, stream, number)
        t = now()
        at = F.lit(str(t)).cast("timestamp_ntz")

        def move(memories: DataFrame) -> dict[str, Change]:
            moved = scan(memories, accesslog.stats(store, t, p), at, p).where("new_state <> ttl_state")
            rows = moved.withColumns({"ttl_state": F.col("new_state"), "updated_at": at}).select(*memories.columns)
            return {"memories": Change("upsert", rows), "changelog": Change("append", changes.moved(moved, at, p))}

        changes.apply(store, "lifecycle", move)

    return access.writeStream.foreachBatch(run)


def hits(results: DataFrame, caller: str, query: str, at: Column) -> DataFrame:
    """The access rows that a recall's results leave behind."""
    return results.select(F.col("id").alias("memory_id"), at.alias("ts"), F.lit("recall_hit").alias("kind"), F.lit(caller).alias("caller"), F.lit(query).alias("query"))


def after_cursor(rows: DataFrame, cursor: int, most: int = 500) -> DataFrame:
    """The next rows by seq after a cursor."""
    return rows.where(F.col("seq") > cursor).orderBy("seq").limit(most)


def pending(recalls: DataFrame, ttl_seconds: int = 600, cap: int = 64) -> DataFrame:
    """host, id and ts of the recalled rows (host, id, ts) that wait to be adopted, after each batch: the `cap` latest of each host that are not older than ttl_seconds.
    The state of a host that stays silent for ttl_seconds, by the clock, goes."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        for batch in batches:
            for i, t in zip(batch["id"], batch["ts"].astype("int64") // 10 ** {"s": 0, "ms": 3, "us": 6, "ns": 9}[batch["ts"].dt.unit], strict=True):
                held[int(i)] = max(int(t), held.get(int(i), 0))
        latest = max(held.values(), default=0)
        best = sorted(((t, i) for i, t in held.items() if latest - t <= ttl_seconds), reverse=True)[:cap]
        state.update(([i for _, i in best], [t for t, _ in best]))
        state.setTimeoutDuration(ttl_seconds * 1000)
        yield pd.DataFrame({"host": [key[0]] * len(best), "id": [i for _, i in best], "at": [t for t, _ in best]})

    return recalls.groupBy("host").applyInPandasWithState(update, "host string, id long, at long", "ids array<long>, ats array<long>", "update", GroupStateTimeout.ProcessingTimeTimeout)
