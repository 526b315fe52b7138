"""The usage-driven life cycle: nine ordered rules over one aggregate of the access log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnesis.functions.columns import days, window_days
from mnesis.model import DEFAULT, Params


def access_stats(access: DataFrame, now: Column, p: Params = DEFAULT) -> DataFrame:
    """What the rules need of the log, by memory: last signal, adoption and access of any kind, hits and adoptions of the last adopt_days. One pass, one shuffle."""
    signal, adopted = F.col("kind").isin("recall_hit", "adopted"), F.col("kind") == "adopted"
    recent = F.col("ts") > now - days(F.lit(p.adopt_days))
    return access.groupBy("memory_id").agg(
        F.max(F.when(signal, F.col("ts"))).alias("last_signal"), F.max(F.when(adopted, F.col("ts"))).alias("last_adopt"), F.max("ts").alias("last_any"),
        F.count_if((F.col("kind") == "recall_hit") & recent).alias("hits"), F.count_if(adopted & recent).alias("adopts"),
    )


def with_stats(memories: DataFrame, access: DataFrame, now: Column, p: Params = DEFAULT) -> DataFrame:
    """access: the log, or what access_stats() or accesslog.stats() made of it."""
    stats = access if "last_signal" in access.columns else access_stats(access, now, p)
    return memories.join(stats, F.col("id") == F.col("memory_id"), "left").drop("memory_id")


def rules(now: Column, p: Params = DEFAULT) -> dict[str, tuple[str, str, Column]]:
    """name: (from state, to state, condition), in the order of the scan."""
    since = lambda c, d: F.coalesce(F.col(c) > now - d, F.lit(False))
    old = lambda d: F.col("created_at") <= now - d
    fixed = lambda n: days(F.lit(n))
    scaled = lambda n: days(window_days(n, p))
    hits, adopts = F.coalesce("hits", F.lit(0)), F.coalesce("adopts", F.lit(0))
    idle = F.greatest(F.coalesce("last_any", "created_at"), F.col("created_at")) <= now - scaled(p.zero_access_days)
    return {
        "promote_candidates": ("candidate", "trial", old(fixed(p.candidate_days))),
        "promotion_gate": ("trial", "active", (hits >= p.promote_hits) & (adopts / F.greatest(hits, F.lit(1)) >= p.promote_ratio)),
        "decay_trials": ("trial", "decaying", old(scaled(p.trial_days)) & ~since("last_signal", scaled(p.trial_days))),
        "decay_active": ("active", "decaying", old(scaled(p.active_days)) & ~since("last_signal", scaled(p.active_days))),
        "revive_decaying": ("decaying", "active", since("last_signal", fixed(p.revive_days))),
        "upgrade_adopted": ("decaying", "active", since("last_adopt", fixed(p.adopt_days))),
        "zero_access_trial": ("trial", "decaying", idle),
        "zero_access_active": ("active", "decaying", idle),
        "archive_decaying": ("decaying", "archived", old(scaled(p.archive_days)) & ~since("last_signal", scaled(p.archive_days))),
    }


def matching(memories: DataFrame, access: DataFrame, now: Column, rule: str, p: Params = DEFAULT) -> DataFrame:
    """The rows that a rule would move if it ran alone."""
    source, _, condition = rules(now, p)[rule]
    return with_stats(memories, access, now, p).where((F.col("ttl_state") == source) & condition)


def scan(memories: DataFrame, access: DataFrame, now: Column, p: Params = DEFAULT) -> DataFrame:
    """The state after all rules in order, each seeing what those before it did: a fold of projections over one join. Adds new_state and moves (the rules' names)."""
    df = with_stats(memories, access, now, p).withColumn("new_state", F.col("ttl_state")).withColumn("moves", F.array().cast("array<string>"))
    for name, (source, target, condition) in rules(now, p).items():
        hit = (F.col("new_state") == source) & condition
        df = df.withColumns({"moves": F.when(hit, F.array_append("moves", F.lit(name))).otherwise(F.col("moves")), "new_state": F.when(hit, F.lit(target)).otherwise(F.col("new_state"))})
    return df


def candidates(memories: DataFrame, access: DataFrame, now: Column, limit: int = 100, p: Params = DEFAULT) -> DataFrame:
    """What a scan would look at: list (promote, decay, archive, l2_upgrade, l2_zero_access), id, ttl_state and eligible; at most `limit` rows of each list."""
    df = with_stats(memories, access, now, p)
    r = rules(now, p)
    gate = r["promotion_gate"][2] & (F.coalesce("hits", F.lit(0)) > 0)
    trial = r["decay_trials"][2]
    lists = {
        "promote": (df.where(F.col("ttl_state").isin("candidate", "trial")), gate, F.desc("access_count")),
        "decay": (df.where(F.col("ttl_state").isin("trial", "active") & trial), F.lit(True), F.asc("created_at")),
        "archive": (df.where((F.col("ttl_state") == "decaying") & r["archive_decaying"][2]), F.lit(True), F.asc("created_at")),
        "l2_upgrade": (df.where((F.col("ttl_state") == "decaying") & r["upgrade_adopted"][2]), F.lit(True), F.asc("updated_at")),
        "l2_zero_access": (df.where(F.col("ttl_state").isin("trial", "active") & r["zero_access_trial"][2]), F.lit(True), F.asc("created_at")),
    }
    out = None
    for name, (rows, eligible, order) in lists.items():
        part = rows.orderBy(order, "id").limit(limit).select(F.lit(name).alias("list"), "id", "ttl_state", eligible.alias("eligible"))
        out = part if out is None else out.unionByName(part)
    return out


#: What a manual action makes of a row.
ACTIONS = {"promote": "active", "demote": "decaying", "archive": "archived", "revive": "active", "trialize": "trial"}


def act(memories: DataFrame, ids: list[int], action: str, now: Column) -> DataFrame:
    if action not in ACTIONS:
        raise ValueError(f"action must be among {sorted(ACTIONS)}")
    return transition(memories, ids, ACTIONS[action], now)


def transition(memories: DataFrame, ids: list[int], target: str, now: Column) -> DataFrame:
    """Manual moves: the given rows get the state and the expiry that goes with it (trial 30 days, decaying 180; none for others)."""
    expiry = {"trial": 30, "decaying": 180}.get(target)
    hit = F.col("id").isin(ids)
    return memories.withColumn("ttl_expires_at", F.when(hit, now + days(F.lit(expiry)) if expiry else F.lit(None).cast("timestamp_ntz"))).withColumn("ttl_state", F.when(hit, F.lit(target)).otherwise(F.col("ttl_state")))
