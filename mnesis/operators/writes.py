"""Write paths as frames: duplicates, version changes, deletions, consolidation."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnesis.functions.columns import cosine, current, days, live, lookup
from mnesis.functions.rules import classify, derive_title, injection_labels, should_scan, staleness
from mnesis.model import BANKS, DEFAULT, Params
from mnesis.operators import recent

def exact_duplicates(batch: DataFrame, memories: DataFrame) -> DataFrame:
    """Rows of a batch (id, bank, content_hash) whose content a current, not retired row of the same bank has: id and the least such row."""
    known = memories.where(current() & live(True)).groupBy("bank", "content_hash").agg(F.min("id").alias("existing"))
    return batch.join(known, ["bank", "content_hash"]).select("id", "existing")


def first_by_key(memories: DataFrame) -> DataFrame:
    """The first row (by seq) of each bank and dedup_key: a min that is added up before the shuffle, not a window over a hot key."""
    return memories.groupBy("bank", "dedup_key").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("copies"))


def nearest(queries: list[tuple[int, str, Sequence[float]]], rows: DataFrame, k: int, least: float = -2.0) -> DataFrame:
    """id, other and cos of the k rows (id, bank, embedding) nearest to each query (id, bank, vector) in its bank, itself left out, at `least` cosine (6 digits), ties to the smaller id.

    The stated queries, a bounded list, go against all rows as matrix products over Arrow batches; a task returns its k best of each."""
    ids, banks = np.array([q[0] for q in queries], np.int64), np.array([q[1] for q in queries], object)
    q = np.array([x[2] for x in queries], float).reshape(len(queries), -1)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0)) for _ in ids]
        for batch in batches:
            if not batch.num_rows:
                continue
            other, bank = batch.column("id").to_numpy(), np.array(batch.column("bank").to_pylist(), object)
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            x = flat.astype(float).reshape(len(other), -1)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            cos = np.floor(q @ np.divide(x, norm, out=np.zeros_like(x), where=norm > 0).T * 1e6 + 0.5) / 1e6
            for i in range(len(ids)):
                ok = np.flatnonzero((bank == banks[i]) & (other != ids[i]) & (cos[i] >= least))
                who, score = np.concatenate([best[i][0], other[ok]]), np.concatenate([best[i][1], cos[i][ok]])
                top = np.lexsort((who, -score))[:k]
                best[i] = who[top], score[top]
        n = [len(w) for w, _ in best]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.concatenate([w for w, _ in best])), pa.array(np.concatenate([c for _, c in best]))], names=["id", "other", "cos"])

    if not queries:
        return rows.sparkSession.createDataFrame([], "id long, other long, cos double")
    got = rows.where(F.col("embedding").isNotNull()).select(F.col("id").cast("long"), "bank", "embedding").mapInArrow(run, "id long, other long, cos double")
    order = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cos"), F.asc("other")))
    return got.withColumn("n", order).where(F.col("n") <= k).drop("n")


def scanned(memories: DataFrame, now: Column, p: Params = DEFAULT) -> DataFrame:
    """What a consolidation looks at: embedded rows in use of the last consolidate_days, the consolidate_limit newest by seq."""
    rows = memories.where(F.col("ttl_state").isin("candidate", "trial", "active") & F.col("embedding").isNotNull() & (F.col("created_at") > now - days(F.lit(p.consolidate_days))))
    return rows.orderBy(F.desc("seq")).limit(p.consolidate_limit)


def similar_pairs(memories: DataFrame, now: Column, p: Params = DEFAULT, best: int = 3) -> DataFrame:
    """a < b and cos of the scanned pairs of which one is among the `best` nearest of the other within its whole bank, at consolidate_cosine."""
    used = memories.where(F.col("ttl_state").isin("candidate", "trial", "active") & F.col("embedding").isNotNull())
    queries = [(r.id, r.bank, r.embedding) for r in scanned(memories, now, p).select("id", "bank", "embedding").collect()]  # consolidate_limit rows at most
    pairs = nearest(queries, used, best, p.consolidate_cosine).where(F.col("other").isin([q[0] for q in queries]) if queries else F.lit(False))
    return pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "cos").distinct()


def groups(pairs: DataFrame) -> DataFrame:
    """id and grp, the least id that pairs lead to. Each round gives a node's larger neighbours its least one, then its smaller ones (large and small stars), so that long
    chains halve; a hub's rows are aggregated before they meet, never gathered. Each round is a checkpoint, and its rows are no more than the pairs."""
    arcs = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    single = pairs.where("a = b").select(F.col("a").alias("id"), F.col("a").alias("grp"))
    arcs = cut(arcs)
    while True:
        both = arcs.unionByName(arcs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("c")).agg(F.least(F.col("c"), F.min("v")).alias("m"))
        large = both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        moved = large.join(least, F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        arcs = cut(moved.unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct())
        # done when all are stars: no centre hangs on another, no node has two
        if arcs.join(arcs.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and arcs.groupBy("u").count().where("count > 1").isEmpty():
            label = arcs.select(F.col("u").alias("id"), F.col("v").alias("grp")).unionByName(arcs.select(F.col("v").alias("id"), F.col("v").alias("grp")))
            return label.unionByName(single.join(label.select("id"), "id", "left_anti")).distinct()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that the cluster names; in a local one where none is named and all runs on this machine."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="mnesis-"))
    return df.checkpoint()


def merge_plan(members: DataFrame) -> DataFrame:
    """One row for each group: the canonical member (greatest priority, accesses, length; the newest of equals) and what it takes over: counters, tags, sources.

    members: grp, id, seq, priority, access_count, adopt_count, body, domain, tags, source_ref. Sources keep the order of the scan, newest first.
    """
    source = F.array_sort(F.collect_list(F.when(F.col("source_ref").isNotNull(), F.struct((-F.col("seq")).alias("at"), "source_ref"))))
    return members.groupBy("grp").agg(
        F.max(F.struct("priority", "access_count", F.length("body").alias("n"), "seq", "id")).alias("best"), F.count(F.lit(1)).alias("members"),
        F.sum("access_count").alias("access_count"), F.sum("adopt_count").alias("adopt_count"), F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("domains"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))), ",").alias("tags"), F.array_join(F.array_distinct(F.transform(source, lambda x: x["source_ref"])), ",").alias("source_refs"),
    ).select("grp", F.col("best.id").alias("canonical"), "members", "access_count", "adopt_count", "domains", "tags", "source_refs")


def merged(memories: DataFrame, plan: DataFrame, members: DataFrame, at: Column) -> DataFrame:
    """The memories after a merge: the canonical rows have their groups' counters, the other members are archived. plan: merge_plan(); members: id, grp."""
    one = plan.select(F.col("canonical").alias("id"), F.col("access_count").alias("new_access"), F.col("adopt_count").alias("new_adopt"))
    out = memories.join(members.select("id", F.lit(True).alias("member")), "id", "left").join(one, "id", "left")
    gone = F.col("member").isNotNull() & F.col("new_access").isNull()
    return out.withColumns({"access_count": F.coalesce("new_access", "access_count"), "adopt_count": F.coalesce("new_adopt", "adopt_count"), "ttl_state": F.when(gone, F.lit("archived")).otherwise(F.col("ttl_state")), "updated_at": F.when(F.col("member"), at).otherwise(F.col("updated_at"))}).select(*memories.columns)


def supersede(memories: DataFrame, patches: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(closed, opened): each patched current row ends at `at` and points to its successor, which begins then and has the patch's fields, else the old ones.

    patches: id, new_id and any columns to change. A row that is already closed stays as it is.
    """
    changed = [c for c in patches.columns if c not in ("id", "new_id")]
    hash_ = F.sha2(F.concat("bank", F.char(F.lit(0)), "body"), 256)
    hit = memories.where(current()).join(patches.select("id", "new_id", *[F.col(c).alias(f"new_{c}") for c in changed]), "id")
    closed = hit.withColumns({"invalid_at": at, "superseded_by": F.col("new_id"), "updated_at": at}).select(*memories.columns)
    opened = hit.withColumns({c: F.coalesce(f"new_{c}", c) for c in changed}).withColumns({"id": F.col("new_id"), "valid_at": at, "created_at": at, "updated_at": at})
    opened = (opened.withColumn("content_hash", hash_) if "body" in changed else opened).select(*memories.columns)
    return closed, opened


def patch(memories: DataFrame, patches: DataFrame, at: Column) -> DataFrame:
    """Rows with the patch's fields where they have some, an update in place: a new body is hashed anew and waits for its embedding, a retired row loses it, a new
    verify_status sets last_verified and a new original_date the staleness, where the rows have such columns. The text of a row that has ended is history and stays."""
    changed = [c for c in patches.columns if c != "id"]
    out = memories.join(patches.select("id", F.lit(True).alias("hit"), *[F.col(c).alias(f"new_{c}") for c in changed]), "id", "left")
    open_ = F.col("hit").isNotNull() & (current() if "body" in changed else F.lit(True))
    set_ = lambda c: open_ & F.col(f"new_{c}").isNotNull()
    fields = {c: F.when(set_(c), F.col(f"new_{c}")).otherwise(F.col(c)) for c in changed} | {"updated_at": F.when(open_, at).otherwise(F.col("updated_at"))}
    if "embedding" in memories.columns and "embedding" not in changed:
        gone = (set_("body") if "body" in changed else F.lit(False)) | ((set_("ttl_state") & (F.col("new_ttl_state") == "retired")) if "ttl_state" in changed else F.lit(False))
        fields["embedding"] = F.when(~F.coalesce(gone, F.lit(False)), F.col("embedding"))
    if "verify_status" in changed and "last_verified" in memories.columns:
        fields["last_verified"] = F.when(set_("verify_status"), at).otherwise(F.col("last_verified"))
    if "original_date" in changed and "staleness" in memories.columns:
        fields["staleness"] = F.when(set_("original_date"), staleness(F.col("new_original_date"), at)).otherwise(F.col("staleness"))
    out = out.withColumns(fields)
    if "body" in changed:
        out = out.withColumn("content_hash", F.sha2(F.concat("bank", F.char(F.lit(0)), "body"), 256))
    return out.select(*memories.columns)


def purge(memories: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hard delete: rows, the edges that touch them, and pointers to them go."""
    gone = ids.select(F.col("id").alias("gone"))
    kept = memories.join(gone, F.col("id") == F.col("gone"), "left_anti")
    pointer = kept.join(gone, F.col("superseded_by") == F.col("gone"), "left")
    kept = pointer.withColumn("superseded_by", F.when(F.col("gone").isNull(), F.col("superseded_by"))).drop("gone")
    left = edges.join(gone, F.col("src") == F.col("gone"), "left_anti").join(gone, F.col("dst") == F.col("gone"), "left_anti")
    return kept, left


def retain_defaults(batch: DataFrame, now: Column, p: Params = DEFAULT) -> DataFrame:
    """What new rows start with: state and expiry by tier (user rows are candidates for 6 days, others on trial for 30), a title from the text, a type by its rules, their key.

    batch: source_tier, title, content, context and memory_type, of which the latter and the title may be null; a missing tier counts as agent."""
    tier = F.lower(F.trim(F.coalesce(F.when(F.col("source_tier") != "", F.col("source_tier")), F.lit("agent"))))
    state = F.when(tier == "user", "candidate").otherwise("trial")
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.col("content"))
    return batch.withColumns({
        "entry_state": state, "expires_at": now + days(F.when(state == "candidate", p.candidate_days).otherwise(p.trial_days)),
        "title": F.coalesce(F.when(F.col("title") != "", F.col("title")), derive_title(F.col("content"))), "memory_type": F.coalesce("memory_type", classify(text)["memory_type"]),
        "dedup_key": F.sha2(F.concat("content", F.char(F.lit(31)), F.coalesce("context", F.lit(""))), 256),
    })


def validated(batch: DataFrame, banks: Sequence[str] = BANKS) -> DataFrame:
    """The batch with reason: context or content (what is blank), bank (an unknown one), else null."""
    blank = lambda c: F.coalesce(F.col(c).rlike(r"^\s*$"), F.lit(True))
    return batch.withColumn("reason", F.when(blank("context"), "context").when(blank("content"), "content").when(~F.coalesce(F.col("bank").isin(*banks), F.lit(False)), "bank"))


def retain(batch: DataFrame, memories: DataFrame, now: Column, scope: str = "external_only", p: Params = DEFAULT) -> DataFrame:
    """What becomes of the rows of a batch: its columns with those of retain_defaults(), status and existing.

    status: invalid (see validated()), injection (a scanned row of the same request matches a pattern: the whole request is turned away), exact (a current,
    not retired row of the bank has the content), key (one has the key, or an earlier item of the batch has), accepted. existing: the row that was there
    before, for exact and key. batch: item (a total order), request, bank, content, context, title, source_tier, memory_type.

    The gates stand in the order of their cost. Keys and hashes are met by the least row of each, aggregated before the shuffle."""
    rows = retain_defaults(validated(batch), now, p).withColumn("content_hash", F.sha2(F.concat("bank", F.char(F.lit(0)), "content"), 256))
    flagged = rows.where(should_scan(F.col("source_tier"), scope)).where(F.size(injection_labels(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.col("content")))) > 0)
    rows = rows.join(flagged.select(F.col("request").alias("bad")).distinct(), F.col("request") == F.col("bad"), "left")
    held = memories.where(current() & (F.col("ttl_state") != "retired"))
    same = held.groupBy("bank", "content_hash").agg(F.min("id").alias("same"))
    keyed = held.groupBy("bank", "dedup_key").agg(F.min_by("id", "seq").alias("keyed"))
    rows = rows.join(same, ["bank", "content_hash"], "left").join(keyed, ["bank", "dedup_key"], "left")
    clean = F.col("reason").isNull() & F.col("bad").isNull()
    fresh = clean & F.col("same").isNull() & F.col("keyed").isNull()
    first = rows.where(fresh).groupBy("bank", "dedup_key").agg(F.min("item").alias("first_item"))
    rows = rows.join(first, ["bank", "dedup_key"], "left")
    status = F.when(F.col("reason").isNotNull(), "invalid").when(F.col("bad").isNotNull(), "injection").when(F.col("same").isNotNull(), "exact").when(F.col("keyed").isNotNull() | (F.col("first_item") < F.col("item")), "key").otherwise("accepted")
    rows = rows.withColumn("status", status).withColumn("existing", F.when(F.col("status") == "exact", F.col("same")).when(F.col("status") == "key", F.col("keyed")))
    return rows.drop("bad", "same", "keyed", "first_item")


def greedy_semantic(batch: list[tuple[int, Sequence[float]]], least: float) -> list[int]:
    """The items of one request that stay when each is compared with those that stay before it: a bounded list, in order, as the rule is sequential."""
    kept: list[int] = []
    vectors: list[np.ndarray] = []
    for item, v in batch:
        x = np.asarray(v, float)
        x = x / max(np.linalg.norm(x), 1e-300)
        if not vectors or (np.floor(np.array(vectors) @ x * 1e6 + 0.5) / 1e6 < least).all():
            kept.append(item)
            vectors.append(x)
    return kept


def semantic_duplicates(batch: DataFrame, known: DataFrame, p: Params = DEFAULT, least: float | None = None, most: int = 4096) -> DataFrame:
    """For each batch row (id, bank, embedding, created_at), the nearest row of its bank of the dedup_days before, if its cosine reaches the bank's threshold.

    Exact, and all rows of a bank and a window meet; rows with a null in their embedding, or none, are similar to none. Both sides of a bank and day are dealt into parts of
    about `most` rows, and a task compares some blocks of a part with a part, so that none holds or compares a whole day. The driver has the number of pairs."""
    limit = F.lit(float(least)) if least is not None else lookup(F.col("bank"), p.dedup_bank_cosine, p.dedup_cosine)

    def sound(rows: DataFrame) -> DataFrame:
        v = F.transform("embedding", lambda x: x.cast("double"))
        return rows.where(F.col("id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull()) & (F.size("embedding") > 0)).withColumns({"v": v, "dim": F.size("embedding")})

    block = ["bank", "day", "dim"]
    old = sound(known).select(F.to_date("created_at").alias("day"), "bank", "dim", "id", F.col("created_at").alias("until"), F.col("created_at").alias("since"), F.lit(0.0).alias("least"), "v")
    new = sound(batch).select("bank", "dim", "id", F.col("created_at").alias("until"), (F.col("created_at") - days(F.lit(p.dedup_days))).alias("since"), limit.cast("double").alias("least"), "v").where("least IS NOT NULL")
    # days are the key: a row meets those of its bank of its own day and of the dedup_days before
    spread = new.withColumn("day", F.explode(F.transform(F.sequence(F.lit(0), F.lit(p.dedup_days)), lambda i: F.date_sub(F.to_date("until"), i))))
    rows = lambda df, n: df.groupBy(*block).agg(F.count(F.lit(1)).alias(n))
    sizes = cut(rows(old, "n_old").join(rows(spread, "n_new"), block))  # a row for each bank and day
    pairs = sizes.agg(F.sum(F.col("n_old") * F.col("n_new"))).first()[0] or 0
    parts = {c: F.ceil(F.col(n) / most).cast("int") for c, n in (("parts", "n_old"), ("lots", "n_new"))}
    sizes = sizes.select(*block, *[x.alias(c) for c, x in parts.items()])
    own = lambda n: F.pmod(F.xxhash64("id", "until"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sides = [old.join(sizes, block).select("*", own("parts").alias("part"), each("lots").alias("lot"), F.lit(0).alias("side")), spread.join(sizes, block).select("*", each("parts").alias("part"), own("lots").alias("lot"), F.lit(1).alias("side"))]
    dealt = sides[0].select(*recent.DEALT).unionByName(sides[1].select(*recent.DEALT)).withColumn("day", F.datediff("day", F.lit("1970-01-01").cast("date")))
    tasks = max(int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // most**2))
    found = recent.nearest(dealt, tasks)
    return found.groupBy("id").agg(F.max(F.struct("cos", (-F.col("existing")).alias("minus"))).alias("m")).select("id", (-F.col("m.minus")).alias("existing"), F.col("m.cos").alias("cos"))
