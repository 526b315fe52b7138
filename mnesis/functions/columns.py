"""Column functions of the memory model: predicates, factors and text rules. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnesis.model import DEFAULT, Params


def lookup(key: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def visible_to(caller: str | None, owner: str = "owner", visibility: str = "visibility") -> Column:
    """A caller sees its own and public rows; main (or none) sees all."""
    return F.lit(True) if caller in (None, "", "main") else (F.col(owner) == caller) | (F.col(visibility) == "public")


def as_of(t: Column) -> Column:
    """Rows whose interval [valid_at, invalid_at) holds t."""
    return (F.coalesce("valid_at", "created_at") <= t) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > t))


def current() -> Column:
    return F.col("invalid_at").isNull()


def live(include_archived: bool = False) -> Column:
    """Neither retired nor, unless asked for, archived."""
    return ~F.col("ttl_state").isin("retired", *([] if include_archived else ["archived"]))


def tenant_scope(tenant: str | None) -> Column:
    """Multi-tenant reads see one tenant's rows only; a row without a tenant is invisible to them."""
    return F.lit(True) if tenant is None else F.coalesce(F.col("tenant_id") == tenant, F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def life_factor(include_archived: bool = False, p: Params = DEFAULT) -> Column:
    table = p.life | ({"archived": p.archived_visible} if include_archived else {})
    return lookup(F.col("ttl_state"), table, 0.85) * lookup(F.col("verify_status"), p.verify, 1.0)


def priority_factor() -> Column:
    return F.lit(0.9) + F.lit(0.05) * F.col("priority").cast("double")


def window_days(base: int, p: Params = DEFAULT) -> Column:
    """The look-back of a row in days, by its memory_type and bank; the table is made on the driver."""
    from mnesis.model import BANKS

    out = F.lit(p.window_days(base, "episodic", ""))
    for t in p.type_factor:
        for b in BANKS:
            out = F.when((F.col("memory_type") == t) & (F.col("bank") == b), F.lit(p.window_days(base, t, b))).otherwise(out)
    return out


def days(n: Column) -> Column:
    return F.make_dt_interval(n.cast("int"))


def auto_score() -> Column:
    """What a memory's use makes of it: polarity above neutral, adoptions, accesses (logarithmic)."""
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    use = F.least(F.lit(1.0), F.log(F.lit(1.0) + F.col("access_count").cast("double")) / F.log(F.lit(51.0)))
    return F.lit(0.5) * clamp((F.coalesce("polarity", F.lit(0.0)) - 0.5) / 0.5) + F.lit(0.3) * F.least(F.lit(1.0), F.col("adopt_count").cast("double") / 10.0) + F.lit(0.2) * use


def normalized_query(query: Column) -> Column:
    """White space of any kind as one space, none at the ends, lower case; null as empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(query, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " ")))


def query_key(query: Column) -> Column:
    """What failed queries are told apart by."""
    return F.sha2(normalized_query(query), 256)


def vector_text(vector: Column) -> Column:
    """A vector as text for export: [x,y,...] with seven decimals, halves to even; null stays."""
    size = lambda x: F.format_string("%.7f", F.bround(F.abs(x.cast("double")).cast("decimal(38,18)"), 7).cast("double"))
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: F.concat(F.when(x < 0, "-").otherwise(""), size(x))), ","), F.lit("]"))


def uuid7(at: Column | None = None) -> Column:
    """A random UUID of version 7, which begins with the time in milliseconds (now, if none is given), as text. Another one each time it is computed: write it before it is used twice."""
    ms = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp() if at is None else at.cast("timestamp")))), 12, "0")
    chance = F.uuid()
    return F.concat(F.left(ms, F.lit(8)), F.lit("-"), F.right(ms, F.lit(4)), F.lit("-7"), F.substring(chance, 16, 3), F.substring(chance, 19, 18))
