"""The access log in a store, with its state beside it: partial aggregates by memory and day. A batch adds its own, and what the rules need of the log is read from them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnesis.model import DEFAULT, Params
from mnesis.sources.commits import Change, Conflict, Store

EVENT = "id long, memory_id long, ts timestamp_ntz, kind string, caller string, query string, day date"
STATE = "memory_id long, day date, events long, hits long, adopts long, last_signal timestamp_ntz, last_adopt timestamp_ntz, last_any timestamp_ntz"
COUNTS, TIMES = ("events", "hits", "adopts"), ("last_signal", "last_adopt", "last_any")


def create(store: Store, buckets: int = 64) -> None:
    """access_events, whose rows of one day are in one bucket, and access_state."""
    store.create("access_events", store.spark.createDataFrame([], EVENT), "day", buckets)
    store.create("access_state", store.spark.createDataFrame([], STATE), "memory_id", buckets)


def partial(events: DataFrame) -> DataFrame:
    """What a set of events comes to, by memory and day (null: without a time)."""
    kind, t = F.col("kind"), F.col("ts")
    signal, adopted = kind.isin("recall_hit", "adopted"), kind == "adopted"
    return events.groupBy("memory_id", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(kind == "recall_hit").alias("hits"), F.count_if(adopted).alias("adopts"),
        F.max(F.when(signal, t)).alias("last_signal"), F.max(F.when(adopted, t)).alias("last_adopt"), F.max("ts").alias("last_any"),
    )


def merged(parts: DataFrame, *by: str | Column) -> DataFrame:
    """Parts of one key as one: numbers are added, of times the last counts, so that it doesn't matter how events were split and in which order they came."""
    return parts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in COUNTS], *[F.max(c).alias(c) for c in TIMES])


def absorb(store: Store, batch: DataFrame, stream: str, number: int) -> int:
    """Append a batch (id, memory_id, ts, kind, caller, query) and its aggregates in one commit; the version. The log isn't read. A number that the stream has passed is of
    no effect. Appends of several streams don't hinder each other."""
    if store.marks().get(stream, -1) >= number:
        return store.version()
    events = batch.select("id", "memory_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "kind", "caller", "query").withColumn("day", F.to_date("ts"))
    return store.commit("access", {"access_events": Change("append", events), "access_state": Change("append", partial(events))}, mark=(stream, number))


def compact(store: Store, now: datetime, p: Params = DEFAULT, tries: int = 5) -> int:
    """Merge the parts of all batches: a row for each memory and day, and one for all days that are too old to count for stats() at `now` or later."""
    first = (now - timedelta(days=p.adopt_days)).date()
    for k in range(tries):
        base = store.version()
        day = F.when(F.col("day") >= F.lit(first), F.col("day")).alias("day")
        try:
            return store.commit("compact", {"access_state": Change("replace", merged(store.read("access_state", base), "memory_id", day).select("memory_id", "day", *COUNTS, *TIMES))}, base)
        except Conflict:
            if k == tries - 1:
                raise
    raise ValueError("tries must be positive")


def stats(store: Store, now: datetime, p: Params = DEFAULT, version: int | None = None) -> DataFrame:
    """lifecycle.access_stats() of the log as it stands in a version: from the aggregates, and from the log the rows of the one day in which the window of adopt_days begins.

    A time before that of a compaction, whose window reaches into days that were merged, is an error."""
    version = store.version() if version is None else version
    cutoff = now - timedelta(days=p.adopt_days)
    day, from_ = F.lit(cutoff.date()), F.lit(str(cutoff)).cast("timestamp_ntz")
    state = store.read("access_state", version)
    gone = F.when(F.col("day").isNull() & (F.col("last_any") > from_), F.raise_error(F.lit("days of this window were merged by a compaction")).cast("long"))
    within = lambda c: F.when(F.coalesce(F.col("day") > day, F.lit(False)), F.col(c)).otherwise(F.coalesce(gone, F.lit(0).cast("long"))).alias(c)
    whole = state.select("memory_id", within("hits"), within("adopts"), *TIMES)
    bucket = store.spark.range(1).select(F.pmod(F.xxhash64(day), F.lit(store.entry(version)["tables"]["access_events"]["buckets"])).alias("b")).first().b
    edge = partial(store.read("access_events", version, [bucket]).where((F.col("day") == day) & (F.col("ts") > from_))).select("memory_id", "hits", "adopts", *TIMES)
    return whole.unionByName(edge).groupBy("memory_id").agg(*[F.max(c).alias(c) for c in TIMES], F.sum("hits").alias("hits"), F.sum("adopts").alias("adopts"))


def counters(store: Store, version: int | None = None) -> DataFrame:
    """memory_id, access_count (hits) and adopt_count as the log has them."""
    return merged(store.read("access_state", version), "memory_id").select("memory_id", F.col("hits").alias("access_count"), F.col("adopts").alias("adopt_count"))
