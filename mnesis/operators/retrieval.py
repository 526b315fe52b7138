"""Hybrid retrieval: vector, text, time and graph routes, fused by weighted reciprocal ranks and multiplied by priors."""

from __future__ import annotations

import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnesis.functions.columns import as_of, cosine, current, life_factor, live, lookup, priority_factor, visible_to
from mnesis.functions.plugins import Reranker
from mnesis.functions.rules import utc, validate_filters
from mnesis.model import DEFAULT, Params
from mnesis.operators import graph


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows by a total order, numbered. The limit is taken before the window, which sees n rows."""
    return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


@dataclass(frozen=True)
class Recall:
    """What is asked for: a vector, terms, whose eyes, and what to narrow it to. See visible() for the filters, whose names and values validate_filters() checks."""

    vector: Sequence[float] | None = None
    terms: Sequence[str] = ()
    caller: str | None = None
    bank: str | None = None
    filters: dict = field(default_factory=dict)
    hops: int = DEFAULT.hops
    top_k: int = 20
    scorer: str = "tf"


def at_utc(value: str) -> Column:
    return F.lit(utc(value).isoformat(sep=" ")).cast("timestamp_ntz")


def visible(spec: Recall) -> Column:
    """The rows that a recall may return: the caller's, of the bank, and by the filters domain, tags (any of them), tenant_id, agent_id, staleness, memory_type,
    date_range (from and to, both inclusive), as_of (else current rows) and include_archived."""
    f = validate_filters(spec.filters)
    many = lambda x: list(x) if isinstance(x, (list, tuple)) else [x]
    out = visible_to(spec.caller) & live(bool(f.get("include_archived")))
    out &= as_of(at_utc(f["as_of"])) if f.get("as_of") else current()
    if spec.bank:
        out &= F.col("bank") == spec.bank
    for name in ("domain", "tenant_id", "agent_id"):
        if f.get(name):
            out &= F.col(name) == str(f[name])
    for name in ("staleness", "memory_type"):
        if f.get(name):
            out &= F.col(name).isin(*map(str, many(f[name])))
    if f.get("tags"):
        out &= F.arrays_overlap("tags", F.array(*[F.lit(str(x)) for x in many(f["tags"])]))
    dates = f.get("date_range") or {}
    if dates.get("from"):
        out &= F.col("created_at") >= at_utc(dates["from"])
    if dates.get("to"):
        out &= F.col("created_at") <= at_utc(dates["to"])
    return out


def vector_route(memories: DataFrame, vectors: DataFrame, query: Sequence[float], n: int = DEFAULT.top_vector, rows: Column | None = None) -> DataFrame:
    """id, rank, score: the n rows of greatest cosine to the query (rounded to 6 digits), ties to the smaller id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    shown = memories.where(current() & live() if rows is None else rows).select("id")
    scored = vectors.join(shown, "id").select("id", F.round(cosine(F.col("embedding"), q), 6).alias("score"))
    return top(scored, n, F.desc("score"), F.asc("id")).select("id", "rank", "score")


def text_route(memories: DataFrame, terms: Sequence[str], n: int = DEFAULT.top_text, scorer: str = "tf", k1: float = 1.2, b: float = 0.75, rows: Column | None = None) -> DataFrame:
    """id, rank, score of rows that have all terms: by the sum of term frequencies (tf) or by bm25.

    Only the query's terms are looked for, each where it stands between other characters than letters and digits: no text is cut into words, and no term is shuffled. For
    tf, texts that lack a term as a plain string are not searched at all; bm25 needs every text's number of words.
    """
    terms = sorted(set(terms))
    words = memories.where(current() & live() if rows is None else rows).select("id", F.lower(F.concat_ws(" ", "title", "body")).alias("text"))
    if scorer == "tf":
        for t in terms:
            words = words.where(F.col("text").contains(t))
    find = lambda pattern: F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    length = F.lit(0) if scorer == "tf" else find("[a-z0-9]+")
    tf = words.select("id", length.alias("length"), *[find(f"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])").alias(f"tf{i}") for i, t in enumerate(terms)])
    has = F.lit(True)
    for i in range(len(terms)):
        has = has & (F.col(f"tf{i}") > 0)
    if scorer == "tf":
        score = sum((F.col(f"tf{i}") for i in range(1, len(terms))), F.col("tf0")).cast("double")
        hits = tf.where(has)
    else:
        # document frequencies and the mean length: one row
        stats = tf.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
        hits, score = tf.where(has).crossJoin(F.broadcast(stats)), None
        for i in range(len(terms)):
            idf = F.log(F.lit(1.0) + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
            part = idf * (F.col(f"tf{i}") * F.lit(k1 + 1)) / (F.col(f"tf{i}") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("length") / F.col("mean")))
            score = part if score is None else score + part
    return top(hits.select("id", F.round(score, 6).alias("score")), n, F.desc("score"), F.asc("id")).select("id", "rank", "score")


def time_route(memories: DataFrame, n: int = DEFAULT.top_time, rows: Column | None = None) -> DataFrame:
    """id and rank of the latest rows in use: by priority, then update; candidates never enter."""
    used = memories.where((current() if rows is None else rows) & F.col("ttl_state").isin("trial", "active", "decaying"))
    return top(used.select("id", "priority", "updated_at"), n, F.desc("priority"), F.desc("updated_at"), F.asc("id")).select("id", "rank")


def seeds(routes: Sequence[DataFrame], p: Params = DEFAULT) -> DataFrame:
    """Up to seeds_per_route ids of each route, in the routes' order, the first seeds_max of them without repeats."""
    parts = [r.where(F.col("rank") <= p.seeds_per_route).select("id", F.struct(F.lit(k).alias("route"), "rank").alias("at")) for k, r in enumerate(routes)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.groupBy("id").agg(F.min("at").alias("at")).orderBy("at", "id").limit(p.seeds_max).select("id")


def held(route: DataFrame) -> DataFrame:
    """A route's few rows as a list on the driver: what reads them later does not compute the route again."""
    rows = route.collect()  # the route's limit at most
    return route.sparkSession.createDataFrame([tuple(r) for r in rows], route.schema)


def graph_route(found: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """id, rank and contribution of what an expansion found (with factor): weighted reciprocal ranks, times hop_decay for each further hop, the edge's weight and the factor."""
    rows = found.withColumn("rank", F.row_number().over(Window.orderBy("hop", F.desc("w"), "id")))  # max_neighbors at most
    return rows.select("id", "rank", (F.lit(p.w_graph) / (p.rrf_k + F.col("rank")) * F.pow(F.lit(p.hop_decay), F.col("hop") - 1) * F.col("w") * F.col("factor")).alias("contribution"))


def fuse(vector: DataFrame, text: DataFrame, time: DataFrame, graph: DataFrame | None = None, p: Params = DEFAULT) -> DataFrame:
    """id, rrf (the weighted reciprocal ranks of the routes, added in their order), graph (its part of that) and routes (the ranks by route). graph: see graph_route()."""
    out = None
    for name, route, w in (("vector", vector, p.w_vector), ("fts", text, p.w_text), ("time", time, p.w_time), *([("graph", graph, None)] if graph is not None else [])):
        part = route.select("id", (F.lit(w) / (F.lit(p.rrf_k) + F.col("rank")) if w is not None else F.col("contribution")).alias(f"w_{name}"), F.col("rank").alias(f"r_{name}"))
        out = part if out is None else out.join(part, "id", "full")
    if graph is None:
        out = out.withColumns({"w_graph": F.lit(0.0), "r_graph": F.lit(None).cast("int")})
    names = ("vector", "fts", "time", "graph")
    z = lambda c: F.coalesce(F.col(f"w_{c}"), F.lit(0.0))
    return out.select("id", (z("vector") + z("fts") + z("time") + z("graph")).alias("rrf"), z("graph").alias("graph"), F.struct(*[F.col(f"r_{c}").alias(c) for c in names]).alias("routes"))


def apply_priors(fused: DataFrame, memories: DataFrame, n: int = 20, include_archived: bool = False, memory_types: Sequence[str] = (), p: Params = DEFAULT) -> DataFrame:
    """The n best by rrf times priority, life, staleness and tier (rounded to 6 digits), ties to the later update, then the smaller id; with the parts of the score.

    Only the few fused ids are joined to the rows' columns: ids alone go through the routes.
    """
    rows = memories.join(F.broadcast(fused), "id")  # at most the routes' limits together
    if memory_types:
        rows = rows.where(F.col("memory_type").isin(*memory_types))
    factors = {"pri": priority_factor(), "life": life_factor(include_archived, p), "stale": lookup(F.col("staleness"), p.stale, 1.0), "tier": lookup(F.col("source_tier"), p.tier, 1.0)}
    rows = rows.withColumns(factors).withColumn("score", F.round(F.col("rrf") * F.col("pri") * F.col("life") * F.col("stale") * F.col("tier"), 6))
    order = [F.desc("score"), F.desc("updated_at"), F.asc("id")]
    got = top(rows, n, *order)
    return got.select("id", "rank", "score", F.round("rrf", 6).alias("rrf"), "pri", "life", "stale", "tier", F.round("graph", 6).alias("graph"), "outcome", "polarity", "routes")


def recall(spec: Recall, memories: DataFrame, vectors: DataFrame, edges: DataFrame, entities: DataFrame, p: Params = DEFAULT) -> tuple[DataFrame, dict[str, str]]:
    """The results of the four routes (see apply_priors), and the routes that failed with why. It is an error only if all of the main routes that were tried failed.

    Each route is run by itself and leaves a short list; the graph starts from the others' first rows, and its failure never counts. Of the graph's rows, those of
    other memory types than asked for go at the end.
    """
    rows, failed = visible(spec), {}
    spark = memories.sparkSession
    at = spec.filters.get("as_of")
    t = at_utc(at) if at else None
    empty = spark.createDataFrame([], "id long, rank int, score double")
    main = {
        "vector": (lambda: vector_route(memories, vectors, spec.vector, p.top_vector, rows)) if spec.vector is not None else None,
        "fts": (lambda: text_route(memories, spec.terms, p.top_text, spec.scorer, rows=rows)) if spec.terms else None,
        "time": lambda: time_route(memories, p.top_time, rows),
    }
    got = {}
    with ThreadPoolExecutor(len(main)) as pool:  # routes are jobs of their own: they run side by side
        tried = {name: pool.submit(lambda r=route: held(r())) if route else None for name, route in main.items()}
        for name, result in tried.items():
            try:
                got[name] = result.result() if result else empty
            except Exception as e:  # noqa: BLE001 - a route that fails leaves the others standing
                got[name], failed[name] = empty, str(e)[:300]
    if len(failed) == sum(r is not None for r in main.values()):
        raise RuntimeError(f"all routes failed: {failed}")
    ranked = None
    if spec.hops > 0:
        try:
            found = graph.expand(seeds(list(got.values()), p), edges, memories, min(3, spec.hops), t, spec.caller, p)
            if spec.vector is not None:
                found = graph.factors(held(found), edges, memories, vectors, entities, F.array(*[F.lit(float(x)) for x in spec.vector]), p)
            else:
                found = found.withColumn("factor", F.lit(1.0))
            ranked = held(graph_route(found, p))
        except Exception as e:  # noqa: BLE001
            failed["graph"] = str(e)[:300]
    types = spec.filters.get("memory_type") or ()
    types = tuple(types) if isinstance(types, (list, tuple)) else (types,)
    return apply_priors(fuse(*got.values(), ranked, p=p), memories, spec.top_k, bool(spec.filters.get("include_archived")), types, p), failed


def rerank(results: DataFrame, relevance: Column, n: int = 10, floor: float = 0.2) -> DataFrame:
    """Blend the first n scores with a relevance in 0..1: score * (floor + (1 - floor) * relevance); all are sorted anew."""
    blended = F.when(F.col("rank") <= n, F.round(F.col("score") * (F.lit(floor) + F.lit(1 - floor) * relevance), 6)).otherwise(F.col("score"))
    out = results.withColumn("blended", blended)
    return out.withColumn("new_rank", F.row_number().over(Window.orderBy(F.desc("blended"), F.asc("rank"))))


def relevance(results: DataFrame, memories: DataFrame, reranker: Reranker) -> DataFrame:
    """The results with what a reranker makes of each row's title and text."""
    scored = memories.join(F.broadcast(results.select("id")), "id").select("id", reranker.relevance(F.concat_ws("\n", "title", "body")).alias("relevance"))  # top_k rows
    return results.join(scored, "id")


def drop_gate(results: DataFrame, ratio: float = 1.1, floor: int = 2) -> DataFrame:
    """Keep results up to the largest ratio of neighbouring scores if that is at least `ratio` (of equal ones the later), else the first `floor`."""
    after = results.withColumn("drop", F.col("score") / F.lead("score").over(Window.orderBy("rank")))
    cut = after.where(F.col("drop") >= ratio).agg(F.coalesce(F.max(F.struct("drop", "rank"))["rank"], F.lit(floor)).alias("cut"))
    return results.crossJoin(F.broadcast(cut)).where("rank <= cut").drop("cut")
