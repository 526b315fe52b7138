"""Core block, feedback and observability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnesis.functions.columns import auto_score, current, live, lookup, visible_to
from mnesis.functions.rules import probe_state, squeezed
from mnesis.model import CORE_HEADER, DEFAULT, OUTCOMES, Params


def core_candidates(memories: DataFrame, caller: str | None = None, p: Params = DEFAULT) -> DataFrame:
    """Two capped tracks of what the caller may see: the newest pinned rows, and of the core_types those with polarity and adoptions enough, by polarity. A row of
    both is pinned. track, id and the columns that rank them."""
    usable = memories.where(current() & live() & visible_to(caller)).withColumn("auto_score", F.round(auto_score(), 6))
    pinned = usable.where("pinned").orderBy(F.desc("seq")).limit(p.core_per_track).withColumn("track", F.lit("pinned"))
    auto = usable.where(F.col("memory_type").isin(*p.core_types) & (F.col("adopt_count") >= p.core_adopts) & (F.col("polarity") >= p.core_polarity))
    auto = auto.orderBy(F.desc_nulls_last("polarity"), F.desc("adopt_count"), F.desc("seq")).limit(p.core_per_track).withColumn("track", F.lit("auto"))
    both = pinned.unionByName(auto).withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("track"))))  # at most two tracks' caps
    return both.where("n = 1").drop("n")


def core_rank(memories: DataFrame, caller: str | None = None, p: Params = DEFAULT) -> DataFrame:
    """position: pinned first (priority, then seq), then automatic (auto_score, then seq)."""
    rows = core_candidates(memories, caller, p)
    order = [F.desc("track"), F.when(F.col("track") == "pinned", -F.col("priority").cast("double")).otherwise(-F.col("auto_score")), F.desc("seq")]
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*order)))  # at most two tracks' caps


def core_render(memories: DataFrame, caller: str | None = None, p: Params = DEFAULT) -> DataFrame:
    """position, id, track and line of the entries that the budget holds. An entry that has less than core_tail characters of room for its text ends the block; one whose
    text is longer than its room is cut there, with a mark, and so fills the budget. Room for the header is kept of the first entry only."""
    rows = core_rank(memories, caller, p)
    meta = F.concat(F.lit("- ("), "bank", F.lit("/"), F.coalesce("memory_type", F.lit("?")), F.lit("·"), "track", F.lit(") "), F.coalesce("title", F.lit("")))
    rows = rows.withColumns({"meta": meta, "text": F.regexp_replace(F.coalesce("body", F.lit("")), r"^\s+|\s+$", "")})
    head = (F.col("position") == 1).cast("int")
    rows = rows.withColumn("size", F.lit(1) - head + F.length("meta") + 2 + F.length("text"))
    before = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("size").over(before), F.lit(0)).cast("int")
    rows = rows.withColumn("room", F.lit(p.core_budget) - used - (F.lit(1) - head) - F.length("meta") - 2 - head * (len(CORE_HEADER) + 1))
    whole = F.col("room") >= F.length("text")
    rows = rows.withColumn("held", (F.col("room") >= p.core_tail) & F.coalesce(F.min(whole & (F.col("room") >= p.core_tail)).over(before), F.lit(True)))
    body = F.when(whole, F.col("text")).otherwise(F.concat(F.expr("left(text, room - 1)"), F.lit("…")))
    return rows.where("held").select("position", "id", "track", F.concat("meta", F.lit(": "), body).alias("line"))


def core_text(lines: DataFrame, candidates: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One row: the block's text (its header and lines, empty without lines, at most the budget), its length, the entries in it and those left out."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n")
    block = lines.agg(F.when(F.count(F.lit(1)) > 0, F.left(F.concat(F.lit(CORE_HEADER + "\n"), joined), F.lit(p.core_budget))).otherwise("").alias("text"), F.count(F.lit(1)).alias("entries"))
    return block.crossJoin(F.broadcast(candidates.agg(F.count(F.lit(1)).alias("n")))).select("text", F.length("text").alias("used_chars"), "entries", (F.col("n") - F.col("entries")).alias("dropped"))


def micro(x: Column) -> Column:
    """Six digits, halves up: the same operations in any engine."""
    return F.floor(x * 1e6 + 0.5) / F.lit(1e6)


def ema(feedback: DataFrame, memories: DataFrame | None = None, p: Params = DEFAULT) -> DataFrame:
    """memory_id, polarity, events: an exponential moving average over each memory's feedback in order of seq, rounded to six digits at each step; from the polarity
    that the memory has (memories: id, polarity), else from zero. Unknown outcomes are an error of the caller and left out.

    A fold over the events of one memory; one with very many is bounded by its own events, which a stream keeps as a single number (see streaming).
    """
    target = lookup(F.col("outcome"), OUTCOMES, None)
    events = feedback.where(F.col("outcome").isin(*OUTCOMES)).groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("seq", target.cast("double").alias("t")))).alias("e"))
    start = F.lit(0.0)
    if memories is not None:
        events = events.join(memories.select("id", F.col("polarity").alias("start")), F.col("memory_id") == F.col("id"))
        start = F.coalesce("start", F.lit(0.0))
    fold = F.aggregate("e", start, lambda s, x: micro(s + F.lit(p.ema_alpha) * (x["t"] - s)))
    return events.select("memory_id", fold.alias("polarity"), F.size("e").cast("long").alias("events"))


def feedback_probe(feedback: DataFrame, memories: DataFrame, since: Column, p: Params = DEFAULT) -> DataFrame:
    """One row: feedback in the window by outcome, distinct memories, those whose outcome_at is in it too, the drift between both, memories with a polarity, those that the
    automatic track may take, and the state of the chain (see probe_state)."""
    seen = feedback.where(F.col("ts") > since)
    counts = seen.agg(F.count(F.lit(1)).alias("writes"), *[F.count_if(F.col("outcome") == x).alias(x) for x in OUTCOMES], F.count_distinct("memory_id").alias("distinct_writes"))
    landed = seen.select("memory_id").distinct().join(memories.where(F.col("outcome_at") > since), F.col("memory_id") == F.col("id"), "left_semi").agg(F.count(F.lit(1)).alias("landed"))
    use = current() & live() & F.col("memory_type").isin(*p.core_types) & (F.col("adopt_count") >= p.core_adopts) & (F.col("polarity") >= p.core_polarity)
    held = memories.agg(F.count_if(current() & live(True) & F.col("polarity").isNotNull()).alias("with_polarity"), F.count_if(use).alias("eligible"))
    one = counts.crossJoin(F.broadcast(landed)).crossJoin(F.broadcast(held))
    return one.withColumn("drift", F.col("distinct_writes") - F.col("landed")).withColumn("state", probe_state(F.col("distinct_writes"), F.col("landed"), F.col("eligible")))


def query_clusters(queries: DataFrame, key: Column, p: Params = DEFAULT) -> DataFrame:
    """qkey, hits, days, callers and reasons (sorted, joined) of the failed queries that share a key: at least cluster_hits of them on cluster_days days."""
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))), ",")
    each = queries.withColumn("qkey", key).groupBy("qkey").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct(F.to_date("ts")).alias("days"), names("caller").alias("callers"), names("reason").alias("reasons"))
    return each.where((F.col("hits") >= p.cluster_hits) & (F.col("days") >= p.cluster_days))


def weekly(queries: DataFrame, since: Column) -> DataFrame:
    """week (ISO year and week), hits, distinct queries, sorted callers and reasons of the failed queries since a time."""
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))), ",")
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), "ts").cast("string"), F.lit("-W"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))
    return queries.where(F.col("ts") >= since).groupBy(week.alias("week")).agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("norm").alias("keys"), names("caller").alias("callers"), names("reason").alias("reasons"))


def hard_trigger(results: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One row for a query's results (rank, score): whether it failed, and why: none found, or the first below hard_score."""
    top = results.agg(F.count(F.lit(1)).alias("found"), F.min_by("score", "rank").alias("top1_score"))
    reason = F.when(F.col("found") == 0, "zero_hit").when(F.col("top1_score") < p.hard_score, "low_score")
    return top.withColumn("reason", reason).withColumn("hard", reason.isNotNull())


def infer_adopted(recalled: DataFrame, turns: DataFrame, body_least: int = 16, title_least: int = 10) -> DataFrame:
    """turn_id and id of the recalled rows that a turn quotes: a window of 32 characters, without white space and in lower case, from the start of the text or from
    its 25th character, or from the title, stands in what the turn says. recalled: turn_id, id, title, body; turns: turn_id, text."""
    b, t = F.left(squeezed(F.col("body")), F.lit(400)), F.left(squeezed(F.col("title")), F.lit(120))
    said = turns.select("turn_id", squeezed(F.col("text")).alias("said"))
    rows = recalled.withColumns({"b": b, "t": t}).join(said, "turn_id")
    use = F.col("said").contains(F.left("b", F.lit(32))) | ((F.length("b") >= 56) & F.col("said").contains(F.substring("b", 25, 32)))
    return rows.where(((F.length("b") >= body_least) & use) | ((F.length("t") >= title_least) & F.col("said").contains(F.left("t", F.lit(32))))).select("turn_id", "id")


def two_state(access: DataFrame, since: Column) -> DataFrame:
    """One row: exposures (hits and injections), consumptions (adoptions) in the window, injections of all time."""
    recent = F.col("ts") > since
    return access.agg(F.count_if(F.col("kind").isin("recall_hit", "injected") & recent).alias("exposed"), F.count_if((F.col("kind") == "adopted") & recent).alias("consumed"), F.count_if(F.col("kind") == "injected").alias("injected_total"))
