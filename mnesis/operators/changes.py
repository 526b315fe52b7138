"""Write paths as changes of tables with their changelog: each gives the rows that change and the log's rows, for one commit.

The log's rows are op, memory_id, detail (JSON) and ts, as many as memories change (or events come in).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnesis.functions.columns import current
from mnesis.model import DEFAULT, OUTCOMES, Params
from mnesis.operators import averages, writes
from mnesis.operators.lifecycle import rules
from mnesis.sources.commits import Change, Conflict, Store

LOG = "op string, memory_id long, detail string, ts timestamp_ntz"


def log_rows(rows: DataFrame, op: str, at: Column, memory_id: str = "id", **detail: Column | str) -> DataFrame:
    """A row of the log for each of `rows`; a detail that is null stands as null."""
    fields = [(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in detail.items()]
    return rows.select(F.lit(op).alias("op"), F.col(memory_id).cast("long").alias("memory_id"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("detail"), at.cast("timestamp_ntz").alias("ts"))


def retained(result: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """The accepted rows of writes.retain() as new memories, whose id is the item, and the log."""
    rows = result.where("status = 'accepted'").select(
        F.col("item").alias("id"), "bank", F.col("context").alias("domain"), "title", F.col("content").alias("body"), F.coalesce("source_tier", F.lit("agent")).alias("source_tier"), F.col("entry_state").alias("ttl_state"), "expires_at", "memory_type",
        "content_hash", "dedup_key", *[at.alias(c) for c in ("valid_at", "created_at", "updated_at")],
    )
    return rows, log_rows(rows, "retain", at, bank="bank", title="title", hash="content_hash", source_tier="source_tier", ttl_state="ttl_state")


def superseded(memories: DataFrame, patches: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """The closed rows and their successors, and the log: supersede for the old row, retain for the new one. A row that is closed already gives nothing."""
    closed, opened = writes.supersede(memories, patches, at)
    log = log_rows(closed, "supersede", at, new_id=F.col("superseded_by").cast("string"), valid_at=F.col("invalid_at").cast("string"))
    new = log_rows(opened, "retain", at, bank="bank", title="title", hash="content_hash", source_tier="source_tier", ttl_state="ttl_state")
    return closed.unionByName(opened), log.unionByName(new)


def patched(memories: DataFrame, patches: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that a patch changes, and the log with the names of the fields it sets. A text of a row that has ended is not changed, and so the row isn't."""
    fields = [c for c in patches.columns if c != "id"]
    hit = memories.where(current()) if "body" in fields else memories
    rows = writes.patch(hit.join(patches.select("id"), "id", "left_semi"), patches, at)
    names = F.filter(F.array(*[F.when(F.col(f"new_{c}").isNotNull(), F.lit(c)) for c in fields]), lambda x: x.isNotNull())
    set_ = rows.select("id").join(patches.select("id", *[F.col(c).alias(f"new_{c}") for c in fields]), "id")
    return rows, log_rows(set_, "update", at, patched=names)


def deleted(memories: DataFrame, ids: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that are retired and lose their embedding, if they have that column, and the log; one that is retired already gives nothing."""
    rows = memories.where("ttl_state <> 'retired'").join(ids.select("id").distinct(), "id", "left_semi").withColumns({"ttl_state": F.lit("retired"), "updated_at": at})
    if "embedding" in rows.columns:
        rows = rows.withColumn("embedding", F.lit(None).cast(dict(memories.dtypes)["embedding"]))
    return rows.select(*memories.columns), log_rows(rows, "delete", at, purge=F.lit(False), state=F.lit("retired"))


def purged(memories: DataFrame, ids: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keys that go, rows that pointed to them with the pointer gone, and the log."""
    gone = memories.join(ids.select("id").distinct(), "id", "left_semi").select("id")
    to = gone.select(F.col("id").alias("superseded_by"))
    pointers = memories.join(to, "superseded_by", "left_semi").join(gone, "id", "left_anti").withColumn("superseded_by", F.lit(None).cast("long")).select(*memories.columns)
    return gone, pointers, log_rows(gone, "delete", at, purge=F.lit(True), state=F.lit("deleted"))


def adopted(memories: DataFrame, adoptions: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with adopt_count raised by their adoptions (id, memory_id, caller), the access events, and the log, a row for each. Unknown memories give nothing."""
    known = adoptions.join(memories.select(F.col("id").alias("memory_id")), "memory_id", "left_semi").withColumn("caller", F.left(F.coalesce("caller", F.lit("main")), F.lit(120)))
    events = known.select("id", "memory_id", at.alias("ts"), F.lit("adopted").alias("kind"), "caller", F.lit(None).cast("string").alias("query"))
    n = known.groupBy(F.col("memory_id").alias("id")).agg(F.count(F.lit(1)).alias("adoptions"))
    rows = memories.join(n, "id").withColumn("adopt_count", (F.col("adopt_count") + F.col("adoptions")).cast(dict(memories.dtypes)["adopt_count"]))
    if "last_accessed_at" in memories.columns:
        rows = rows.withColumn("last_accessed_at", at)
    return rows.select(*memories.columns), events, log_rows(known, "adopt", at, "memory_id", caller="caller")


def fed_back(memories: DataFrame, feedback: DataFrame, at: Column, p: Params = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What feedback (seq, memory_id, outcome, caller, grp) does, in order of seq: the rows with their new polarity, last outcome and its time, and adopt_count raised by what was
    adopted; the access events of these; and the log, a row for each event with the polarity before and after it. State, text and updated_at stay. Events of unknown memories
    give nothing, unknown outcomes are an error. seq is unique."""
    known = F.when(F.col("outcome").isin(*OUTCOMES), F.col("outcome")).otherwise(F.raise_error(F.concat(F.lit("unknown outcome: "), F.coalesce("outcome", F.lit("null")))))
    given = feedback.withColumns({"outcome": known, "caller": F.left(F.coalesce("caller", F.lit("")), F.lit(120))})
    each = averages.steps(given, memories.select("id", "polarity"), p, ("caller", "grp"))
    last = each.groupBy(F.col("memory_id").alias("id")).agg(F.max_by(F.struct("after", F.col("outcome").alias("said")), "seq").alias("l"), F.count_if(F.col("outcome") == "adopted").alias("adoptions"))
    new = {"polarity": F.col("l.after"), "outcome": F.col("l.said"), "outcome_at": at, "adopt_count": (F.col("adopt_count") + F.col("adoptions")).cast(dict(memories.dtypes)["adopt_count"])}
    if "last_accessed_at" in memories.columns:
        new["last_accessed_at"] = F.when(F.col("adoptions") > 0, at).otherwise(F.col("last_accessed_at"))
    rows = memories.join(last, "id").withColumns(new).select(*memories.columns)
    events = each.where("outcome = 'adopted'").select(F.col("seq").alias("id"), "memory_id", at.alias("ts"), F.lit("adopted").alias("kind"), F.when(F.col("caller") != "", F.col("caller")).otherwise("unknown").alias("caller"), F.lit(None).cast("string").alias("query"))
    fields = [F.col("outcome"), F.col("before").alias("polarity_prev"), F.col("after").alias("polarity"), F.lit(p.ema_alpha).alias("alpha"), F.col("caller")]
    full = {"ignoreNullFields": "false"}
    detail = F.when(F.coalesce(F.col("grp") != "", F.lit(False)), F.to_json(F.struct(*fields, F.col("grp").alias("group")), full)).otherwise(F.to_json(F.struct(*fields), full))
    log = each.select(F.lit("feedback").alias("op"), "memory_id", detail.alias("detail"), at.cast("timestamp_ntz").alias("ts"))
    return rows, events, log


def consolidated(memories: DataFrame, plan: DataFrame, members: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """The rows of merged groups, see writes.merged(), and the log: for each canonical row whom it took in, their sources and the group's size."""
    rows = writes.merged(memories.join(members.select("id"), "id", "left_semi"), plan, members, at)
    others = members.join(plan.select("grp", "canonical"), "grp").where(F.col("id") != F.col("canonical")).groupBy("grp").agg(F.array_sort(F.collect_list(F.col("id").cast("string"))).alias("merged_from"))
    each = plan.join(others, "grp", "left")
    return rows, log_rows(each, "consolidate", at, "canonical", merged_from="merged_from", source_refs="source_refs", group_size="members")


def moved(scanned: DataFrame, at: Column, p: Params = DEFAULT) -> DataFrame:
    """The log of lifecycle.scan(): for each move of a row its states before and after, and the rule."""
    steps = F.create_map(*[F.lit(x) for name, (source, target, _) in rules(at, p).items() for x in (name, f"{source} {target}")])
    each = scanned.select("id", F.explode("moves").alias("rule")).withColumn("step", F.split(steps[F.col("rule")], " "))
    return log_rows(each, "lifecycle", at, **{"from": F.col("step")[0], "to": F.col("step")[1], "reason": F.col("rule")})


def apply(store: Store, op: str, make: Callable[[DataFrame], dict[str, Change]], tries: int = 5) -> int:
    """Make the changes of the last version's memories and commit them; after a conflict, from the version that won, `tries` times at most."""
    for k in range(tries):
        base = store.version()
        try:
            return store.commit(op, make(store.read("memories", base)), base)
        except Conflict:
            if k == tries - 1:
                raise
    raise ValueError("tries must be positive")
