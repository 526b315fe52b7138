"""Reads over the memory tables: lists, exports, counts, observability, snapshots and audits of the graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnesis.functions.columns import current, live
from mnesis.model import DEFAULT, STATES, Params


def list_memories(memories: DataFrame, where: Column | None = None, **equal: str | None) -> DataFrame:
    """The rows of a list: those of all the given columns' values (bank, ttl_state, owner, domain, tenant_id, agent_id, memory_type; None: any) and of a condition.
    Historical versions are among them unless the condition leaves them out."""
    out = memories if where is None else memories.where(where)
    for name, value in equal.items():
        out = out if value is None else out.where(F.col(name) == value)
    return out


def page(rows: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of a list, newest seq first; at most 200 rows."""
    return rows.orderBy(F.desc("seq")).offset(max(0, offset)).limit(max(1, min(200, limit)))


def with_embedding(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    return rows.join(vectors.select("id", F.lit(True).alias("has_embedding")), "id", "left").withColumn("has_embedding", F.coalesce("has_embedding", F.lit(False)))


def after_seq(memories: DataFrame, since: int = 0, limit: int = 100_000) -> DataFrame:
    """What an export returns: the rows after a seq, in its order."""
    return memories.where(F.col("seq") > since).orderBy("seq").limit(limit)


def as_json(rows: DataFrame, *columns: str) -> DataFrame:
    """One JSON object a row (value), nulls left out: the lines that write.text() puts into a JSONL file."""
    return rows.select(F.to_json(F.struct(*columns)).alias("value"))


def stale_embeddings(memories: DataFrame, vectors: DataFrame, version: int, limit: int = 200) -> DataFrame:
    """Embedded rows in use whose vector is of an earlier version, by seq."""
    rows = memories.where((F.col("embed_ver") < version) & (F.col("ttl_state") != "retired"))
    return rows.join(vectors.select("id"), "id", "left_semi").orderBy("seq").limit(limit).select("id", "seq")


def purgeable(memories: DataFrame, before: Column) -> DataFrame:
    """Archived rows that were last updated before a time, with a short title."""
    return memories.where((F.col("ttl_state") == "archived") & (F.col("updated_at") < before)).select("id", F.left("title", F.lit(80)).alias("title"), "updated_at")


def purge_gate(targets: DataFrame, exported: DataFrame) -> bool:
    """Whether an export holds as many rows as are to be deleted."""
    return targets.count() == exported.count()


def rescaled(value: Column) -> Column:
    """A priority of 0 to 100 as one of 1 to 5."""
    return F.least(F.lit(5).cast("long"), F.greatest(F.lit(1).cast("long"), F.floor(value / 20)))


def trimmed(rows: DataFrame, most: int = 200) -> DataFrame:
    """id, excerpt of the text and whether it was cut."""
    return rows.select("id", F.left("body", F.lit(most)).alias("excerpt"), (F.length("body") > most).alias("truncated"))


def recent(memories: DataFrame, now: Column, days: int, limit: int = 20) -> DataFrame:
    return page(memories.where(F.col("created_at") > now - F.make_dt_interval(F.lit(days))), limit)


def counts(memories: DataFrame, edges: DataFrame, log: DataFrame) -> DataFrame:
    """One row: memories and their greatest seq, edges and current ones, rows of the log."""
    one = memories.agg(F.count(F.lit(1)).alias("n_memories"), F.max("seq").alias("max_seq"))
    return one.crossJoin(F.broadcast(edges.agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("invalid_at").isNull()).alias("current_edges")))).crossJoin(F.broadcast(log.agg(F.count(F.lit(1)).alias("changelog"))))


def turns(sessions: DataFrame, gold: DataFrame) -> DataFrame:
    """The user's turns of sessions (session_id, turns: array of role and content): turn_id (session_n), session_id, text, chars and is_gold (its turn_id is among gold's). Ids
    of answer sessions are rewritten, so that they don't tell."""
    each = sessions.select("session_id", F.posexplode("turns").alias("n", "t")).where(F.col("t.role") == "user")
    clean = F.regexp_replace("session_id", "answer", "noans")
    each = each.select(F.concat("session_id", F.lit("_"), F.col("n")).alias("own"), F.concat(clean, F.lit("_"), F.col("n")).alias("turn_id"), clean.alias("session_id"), F.col("t.content").alias("text"), F.length("t.content").alias("chars"))
    marks = gold.select(F.col("turn_id").alias("own"), F.lit(True).alias("is_gold")).distinct()
    return each.join(marks, "own", "left").select("turn_id", "session_id", "text", "chars", F.coalesce("is_gold", F.lit(False)).alias("is_gold"))


def corpus_stats(turns: DataFrame) -> DataFrame:
    return turns.agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("session_id").alias("sessions"), F.sum("chars").cast("long").alias("chars"), F.count_if("is_gold").alias("gold"))


def reconcile(expected: DataFrame, present: DataFrame) -> DataFrame:
    """id and side of what is missing (expected only) or extra (present only)."""
    a, b = expected.select("id").distinct(), present.select("id").distinct()
    return a.join(b, "id", "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, "id", "left_anti").withColumn("side", F.lit("extra")))


def gold_missing(expected: DataFrame, present: DataFrame, gold: DataFrame) -> DataFrame:
    """qid, missing and of: the questions that lose right rows (gold: qid, id) to what was expected and is not there, how many they lose, and of how many."""
    lost = reconcile(expected, present).where("side = 'missing'").select("id", F.lit(1).alias("lost"))
    each = gold.select("qid", "id").distinct().join(lost, "id", "left").groupBy("qid").agg(F.count("lost").alias("missing"), F.count(F.lit(1)).alias("of"))
    return each.where("missing > 0")


def sampled(rows: DataFrame, seed: str, n: int, key: str = "id") -> DataFrame:
    """n rows, the first in the order of a hash of seed and key: the same in each run and engine."""
    return rows.withColumn("_order", F.md5(F.concat(F.lit(seed), F.lit(":"), F.col(key).cast("string")))).orderBy("_order", key).limit(n).drop("_order")


def state_summary(memories: DataFrame) -> DataFrame:
    """Rows by state, all states named."""
    states = memories.sparkSession.createDataFrame([(s,) for s in STATES], "ttl_state string")
    return states.join(memories.groupBy("ttl_state").agg(F.count(F.lit(1)).alias("c")), "ttl_state", "left").select("ttl_state", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def feedback_groups(feedback: DataFrame, limit: int = 20) -> DataFrame:
    """Feedback by the group that its detail (JSON) names: numbers by outcome, memories, first and last time; the latest groups first."""
    rows = feedback.withColumns({"grp": F.get_json_object("detail", "$.group"), "o": F.get_json_object("detail", "$.outcome")}).where("grp IS NOT NULL")
    by = [F.count_if(F.col("o") == x).alias(x) for x in ("adopted", "corrected", "useless")]
    out = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *by, F.count_distinct("memory_id").alias("n_memories"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    return out.orderBy(F.desc("last_at"), "grp").limit(limit)


def feedback_group(feedback: DataFrame, group: str) -> DataFrame:
    return feedback.where(F.get_json_object("detail", "$.group") == group).orderBy("seq").select("seq", "memory_id", F.get_json_object("detail", "$.outcome").alias("outcome"), "caller")


def by_kind(access: DataFrame, since: Column) -> DataFrame:
    return access.where(F.col("ts") > since).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("memory_id").alias("n_memories"))


def signals(access: DataFrame, kind: str, name: str) -> DataFrame:
    """How often each memory has a kind of signal: counters are derived from the log, never bumped."""
    return access.where(F.col("kind") == kind).groupBy("memory_id").agg(F.count(F.lit(1)).alias(name))


def renewals(memories: DataFrame, access: DataFrame, since: Column) -> DataFrame:
    """One row: active memories that were adopted since."""
    adopted = access.where((F.col("kind") == "adopted") & (F.col("ts") > since)).select(F.col("memory_id").alias("id"))
    return memories.where("ttl_state = 'active'").join(adopted, "id", "left_semi").agg(F.count(F.lit(1)).alias("n"))


def orphan_adopts(memories: DataFrame, access: DataFrame) -> DataFrame:
    """Memories that count adoptions which the log doesn't have."""
    return memories.where("adopt_count > 0").join(access.where("kind = 'adopted'").select(F.col("memory_id").alias("id")), "id", "left_anti").select("id", "adopt_count")


def pinned_share(memories: DataFrame) -> DataFrame:
    """Pinned and all visible rows and their ratio (4 digits), by bank and over all (bank null); most pinned first."""
    rows = memories.where(current() & live()).rollup("bank").agg(F.count_if("pinned").alias("pinned"), F.count(F.lit(1)).alias("total"))
    return rows.withColumn("ratio", F.when(F.col("total") > 0, F.round(F.col("pinned") / F.col("total"), 4)).otherwise(0.0)).orderBy(F.desc("pinned"), F.desc("total"), "bank")


def domain_clusters(memories: DataFrame, least: int = 5, limit: int = 10) -> DataFrame:
    rows = memories.where(current() & live()).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.sum("access_count").alias("accesses"))
    return rows.where(F.col("n") >= least).orderBy(F.desc_nulls_last("accesses"), F.desc("n"), "domain").limit(limit)


def domain_members(memories: DataFrame, most: int = 20, chars: int = 400) -> DataFrame:
    w = Window.partitionBy("domain").orderBy(F.desc_nulls_last("access_count"), "id")
    return memories.where(current() & live()).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("domain", "id", F.left("body", F.lit(chars)).alias("excerpt"))


def first_of_key(memories: DataFrame) -> DataFrame:
    """The row of each bank and dedup_key with the least seq."""
    return memories.groupBy("bank", "dedup_key").agg(F.min_by("id", "seq").alias("id")).select("id", "bank")


def latest_queries(access: DataFrame) -> DataFrame:
    """The query of each memory's last hit."""
    hits = access.where("kind = 'recall_hit' AND query IS NOT NULL AND query <> ''")
    return hits.groupBy("memory_id").agg(F.max_by("query", F.struct("ts", "id")).alias("query"))


def rounds(conversations: DataFrame) -> DataFrame:
    """Each user turn with the assistant's that follows it, if one does."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    reply = F.when(F.lead("role").over(w) == "assistant", F.lead("text").over(w))
    return conversations.withColumn("reply", reply).where("role = 'user'").select("conv_id", "turn", "text", "reply")


def hard_queries(queries: DataFrame, since: Column, reason: str | None = None, limit: int = 500) -> DataFrame:
    """The failed queries since a time, for a reason or any, newest first."""
    rows = queries.where(F.col("ts") > since)
    return (rows if reason is None else rows.where(F.col("reason") == reason)).orderBy(F.desc("ts"), F.desc("id")).limit(limit).select("id", "norm", "reason", "caller")


def hard_pool(queries: DataFrame, p: Params = DEFAULT, again: bool = True) -> DataFrame:
    """The newest hard_cap failed queries that are long enough; one that came within hard_ttl_days after an earlier one of the same text is not taken, and where a text
    may not come `again`, none after its first.

    As many as a key has in its first days collapse into the first; a later one counts from the last that was taken."""
    long = queries.where(F.length(F.trim("query")) >= p.hard_min_length)
    if again:
        rows = long.groupBy("norm").agg(F.array_sort(F.collect_list(F.struct("ts", "id"))).alias("seen"))
        later = lambda a, x: F.when((F.size(a) == 0) | (x["ts"] >= F.element_at(a, -1)["ts"] + F.make_dt_interval(F.lit(p.hard_ttl_days))), F.concat(a, F.array(x))).otherwise(a)
        taken = rows.select(F.explode(F.aggregate("seen", F.slice("seen", 1, 0), later)).alias("x"))
    else:
        taken = long.groupBy("norm").agg(F.min(F.struct("ts", "id")).alias("x"))
    return taken.select("x.id", "x.ts").orderBy(F.desc("ts"), F.desc("id")).limit(p.hard_cap).select("id")


def latency(events: DataFrame, *shares: int) -> DataFrame:
    """kind and the value at each share (percent) of its sorted values (nulls first), by index: number floor(n * share / 100), from 1.

    Exact, whatever a kind's size: an approximate quantile on either side of a share, surely within a thousandth of its place, bounds the values that are counted one by
    one; of those below only the number counts.
    """
    near = lambda s, d: F.percentile_approx("value", min(1.0, max(0.0, s / 100 + d)), 10_000)
    low = lambda s: F.lit(None) if s <= 1 else near(s, -0.002)
    high = lambda s: F.lit(None) if s >= 99 else near(s, 0.002)
    sides = [F.struct(F.lit(s).alias("share"), low(s).cast("double").alias("low"), high(s).cast("double").alias("high")) for s in shares]
    known = events.where("kind IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("value").isNull()).alias("nulls"), F.array(*sides).alias("sides"))
    bounds = known.select("kind", "total", "nulls", F.inline("sides")).withColumn("at", F.greatest(F.lit(1).cast("long"), F.floor(F.col("total") * F.col("share") / 100)) - F.col("nulls")).where("at > 0")
    each = events.where("value IS NOT NULL").select("kind", F.col("value").alias("v")).join(bounds, "kind").where("high IS NULL OR v <= high")
    under = F.coalesce(F.col("v") < F.col("low"), F.lit(False))
    counts = each.groupBy("kind", "share", "at", F.when(~under, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("kind", "share").orderBy(F.asc_nulls_first("v"))
    reached = counts.withColumn("upto", F.sum("n").over(w)).where("upto >= at").groupBy("kind", "share").agg(F.min("v").alias("v"))
    out = known.select("kind").join(reached, "kind", "left")
    return out.groupBy("kind").agg(*[F.max(F.when(F.col("share") == s, F.col("v"))).alias(f"p{s}") for s in shares])


def superseded_backfill(memories: DataFrame, log: DataFrame) -> DataFrame:
    """id and superseded_by of all rows, where the pointer is missing that of the latest log row (seq, memory_id, successor) whose successor exists."""
    latest = log.join(memories.select(F.col("id").alias("successor")), "successor", "left_semi").groupBy("memory_id").agg(F.max_by("successor", "seq").alias("successor"))
    return memories.join(latest, F.col("id") == F.col("memory_id"), "left").select("id", F.coalesce("superseded_by", "successor").alias("superseded_by"))


def bridges(edges: DataFrame, fanout: int = DEFAULT.fanout) -> DataFrame:
    """a, b, entity_id and w: the first `fanout` bridges of each memory over an entity that it shares with another, by the ids of the two edges.

    Of an entity's edges 2 * fanout can be a second one for some memory: the first ones, of each memory its first `fanout`. They stand in a list, and a memory's edges
    take from theirs what those before them left: rows are the edges and the result, no edge meets a list as rows."""
    e = edges.where("entity_id IS NOT NULL AND invalid_at IS NULL").select("id", "src", "entity_id", "weight")
    number = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("id"))
    far = e.withColumn("n", number("entity_id", "src")).where(F.col("n") <= fanout).withColumn("n", number("entity_id")).where(F.col("n") <= 2 * fanout)
    lists = far.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct(F.col("id").alias("id2"), F.col("src").alias("b"), F.col("weight").alias("w2")))).alias("far"))
    others = F.filter("far", lambda x: x["b"] != F.col("src"))
    each = e.join(lists, "entity_id").select("id", "src", "entity_id", "weight", F.size(others).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    open_ = each.withColumn("room", (fanout - before).cast("int")).where("room > 0")
    return open_.join(lists, "entity_id").select(F.col("src").alias("a"), "entity_id", "weight", F.explode(F.slice(others, F.lit(1), F.col("room"))).alias("x")).select("a", "x.b", "entity_id", (F.col("weight") * F.col("x.w2")).alias("w"))


def snapshot(edges: DataFrame, memories: DataFrame, where: Column, limit: int = 10_000) -> DataFrame:
    """The latest current edges, at most `limit`, among the memories of a condition (an entity's edges need their source there), with truncated: there were as many."""
    ids = memories.where(where).select("id")
    inside = edges.where(F.col("invalid_at").isNull()).join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    linked = inside.where("dst IS NOT NULL").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").unionByName(inside.where("dst IS NULL"))
    rows = linked.orderBy(F.desc("valid_at"), "id").limit(limit)
    return rows.withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) >= limit).select("id", "src", "dst", "entity_id", "etype", "truncated")


def snapshot_nodes(links: DataFrame, memories: DataFrame, entities: DataFrame) -> DataFrame:
    """id, kind and label of what a snapshot's edges touch."""
    ids = links.select(F.col("src").alias("id")).unionByName(links.select(F.coalesce("dst", "entity_id").alias("id"))).distinct()
    named = memories.select("id", F.lit("memory").alias("kind"), F.col("title").alias("label")).unionByName(entities.select("id", F.lit("entity").alias("kind"), F.col("name").alias("label")))
    return named.join(ids, "id", "left_semi")


def edge_audit(edges: DataFrame, memories: DataFrame) -> DataFrame:
    """Current edges that should have ended: T1 an end is retired, T2 an end was superseded; with the time that is proposed."""
    ends = lambda n: memories.select(F.col("id").alias(n), F.struct("ttl_state", "invalid_at", "updated_at").alias(f"{n}_"))
    rows = edges.where("invalid_at IS NULL AND dst IS NOT NULL").select("id", "src", "dst").join(ends("src"), "src", "left").join(ends("dst"), "dst", "left")
    retired = F.coalesce(F.col("src_.ttl_state") == "retired", F.lit(False)) | F.coalesce(F.col("dst_.ttl_state") == "retired", F.lit(False))
    rows = rows.where(retired | F.col("src_.invalid_at").isNotNull() | F.col("dst_.invalid_at").isNotNull())
    return rows.select("id", F.when(retired, "T1").otherwise("T2").alias("reason"), F.coalesce("src_.invalid_at", "dst_.invalid_at", F.least("src_.updated_at", "dst_.updated_at")).alias("proposed"))


def new_edges(proposed: DataFrame, edges: DataFrame) -> DataFrame:
    """Proposed triples (src, dst, etype), each once, that no current edge has."""
    return proposed.distinct().join(edges.where("invalid_at IS NULL").select("src", "dst", "etype"), ["src", "dst", "etype"], "left_anti")


def soft_deleted(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows after a soft delete: those of ids are retired and lose their embedding."""
    gone = memories.join(ids.select("id", F.lit(True).alias("gone")), "id", "left")
    return gone.withColumns({"ttl_state": F.when(F.col("gone"), "retired").otherwise(F.col("ttl_state")), "embedding": F.when(F.col("gone").isNull(), F.col("embedding"))}).drop("gone")


def type_report(memories: DataFrame, label: Column) -> DataFrame:
    """memory_type, rule, bank and number of rows, by what the rules make of each. label: classify() of the text."""
    return memories.select("bank", label.alias("l")).groupBy("l.memory_type", "l.rule", "bank").agg(F.count(F.lit(1)).alias("n"))


def type_samples(memories: DataFrame, label: Column, most: int = 3) -> DataFrame:
    """The first `most` rows (by seq) of each type and rule."""
    rows = memories.select("id", "seq", "bank", F.left("title", F.lit(80)).alias("title"), label.alias("l")).select("*", "l.memory_type", "l.rule")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("memory_type", "rule").orderBy("seq"))).where(F.col("n") <= most).select("memory_type", "rule", "id", "bank", "title")


def attachments(uploads: DataFrame, mime: Column, most: int = 20 << 20) -> DataFrame:
    """memory_id, content_hash, mime, bytes, path and verdict (size, type or accepted) of uploads (memory_id, content: base64); of equal accepted content of a memory one row."""
    rows = uploads.withColumn("content", F.try_to_binary("content", F.lit("base64"))).withColumns({"bytes": F.octet_length("content"), "mime": mime, "content_hash": F.sha2("content", 256)})
    verdict = F.when(F.coalesce(F.col("bytes") == 0, F.lit(True)) | (F.col("bytes") > most), "size").when(F.col("mime").isNull(), "type").otherwise("accepted")
    path = F.concat(F.left("content_hash", F.lit(2)), F.lit("/"), "content_hash", F.lit("."), F.when(F.col("mime") == "image/jpeg", "jpg").otherwise(F.regexp_replace("mime", "image/", "")))
    return rows.withColumns({"verdict": verdict, "path": F.when(verdict == "accepted", path)}).select("memory_id", "content_hash", "mime", "bytes", "path", "verdict").dropDuplicates(["memory_id", "content_hash"])


def refcounts(attachments: DataFrame) -> DataFrame:
    """How many undeleted attachments share each content: bytes without any may be purged."""
    return attachments.groupBy("content_hash").agg(F.count_if(F.col("state") != "deleted").alias("refs"))


def tenant_view(rows: DataFrame, setting: str = "mnesis.tenant") -> DataFrame:
    """The rows that the session's tenant may see: all if the session names none, else its own."""
    tenant = rows.sparkSession.conf.get(setting, None)
    return rows if not tenant else rows.where(F.coalesce(F.col("tenant_id") == tenant, F.lit(False)))


def tenant_write(rows: DataFrame, setting: str = "mnesis.tenant") -> DataFrame:
    """The rows, each of which must be the session's tenant's if that names one: a foreign one fails the write."""
    tenant = rows.sparkSession.conf.get(setting, None)
    return rows if not tenant else rows.where(F.when(F.coalesce(F.col("tenant_id") == tenant, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("a row of another tenant"))))


def lifecycle_log(scanned: DataFrame) -> DataFrame:
    """The log rows of a life-cycle scan: one for each row and move, from, to and the rule. scanned: id, ttl_state, new_state and moves."""
    return scanned.where(F.size("moves") > 0).select("id", F.col("ttl_state").alias("from"), F.col("new_state").alias("to"), F.posexplode("moves").alias("step", "rule"))


def history(log: DataFrame, limit: int = 50) -> DataFrame:
    """The latest rows of the life-cycle log by seq, at most 500."""
    return log.orderBy(F.desc("seq")).limit(max(1, min(500, limit)))


def read_hard_pool(spark, path: str | Sequence[str]) -> DataFrame:
    """A pool of failed queries kept as JSON lines: bad lines and those without a key are left out."""
    schema = "ts string, ts_epoch double, key string, query string, caller string, bank string, top1_score double, reason string"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("key IS NOT NULL AND key <> ''")
