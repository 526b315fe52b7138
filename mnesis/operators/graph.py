"""The typed graph of memories and entities: bounded expansion, chains, snapshots, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnesis.functions.columns import as_of, cosine, current, live, visible_to
from mnesis.model import DEFAULT, EDGE_TYPES, ENTITY_TYPES, Params
from mnesis.operators.writes import cut


def at_time(t: Column | None) -> Column:
    """Edges that hold now (no end), or at t."""
    return F.col("invalid_at").isNull() if t is None else (F.col("valid_at") <= t) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > t))


def step(frontier: list[int], edges: DataFrame, fanout: int = DEFAULT.fanout) -> DataFrame:
    """neighbor, w, via of each frontier id, a bounded list: both directions and entity bridges, at most `fanout` of each kind by edge id.

    The list goes to the scan as a filter. A bridge's second edges are cut for each entity before they meet its first ones: of any entity `fanout` + 1 at most can be used.
    """

    def first(df: DataFrame, key: str, most: int, *order: str) -> DataFrame:
        return df.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("n") <= most)

    e = edges.select("id", "src", "dst", "entity_id", "weight")
    links, mentions = e.where("dst IS NOT NULL"), e.where("entity_id IS NOT NULL")
    none = F.lit(None).cast("long").alias("via")
    out = first(links.where(F.col("src").isin(frontier)), "src", fanout, "id").select(F.col("dst").alias("neighbor"), F.col("weight").alias("w"), none)
    back = first(links.where(F.col("dst").isin(frontier)), "dst", fanout, "id").select(F.col("src").alias("neighbor"), F.col("weight").alias("w"), none)
    one = mentions.where(F.col("src").isin(frontier)).select(F.col("src").alias("f"), F.col("id").alias("id1"), "entity_id", F.col("weight").alias("w1"))
    held = [r.entity_id for r in first(one, "f", fanout, "id1").select("entity_id").distinct().collect()]  # fanout for each of the frontier at most
    two = first(mentions.where(F.col("entity_id").isin(held)), "entity_id", fanout + 1, "id").select(F.col("id").alias("id2"), F.col("entity_id").alias("entity2"), "src", F.col("weight").alias("w2"))
    bridge = first(one.where(F.col("entity_id").isin(held)).join(two, (F.col("entity_id") == F.col("entity2")) & (F.col("src") != F.col("f"))), "f", fanout, "id1", "id2")
    bridge = bridge.select(F.col("src").alias("neighbor"), (F.col("w1") * F.col("w2")).alias("w"), F.col("entity_id").alias("via"))
    return out.unionByName(back).unionByName(bridge)


FOUND = "id long, hop int, w double, vias array<long>"


def expand(seeds: DataFrame | list[int], edges: DataFrame, memories: DataFrame, hops: int = 2, t: Column | None = None, caller: str | None = None, p: Params = DEFAULT) -> DataFrame:
    """id, hop, w and vias of the memories within `hops` of the seeds: per hop the hop_top_k new ones of greatest weight, until max_neighbors are found.

    The weight is that of the last step. Seeds are not returned. Rows that are not visible now (or at t, or to the caller) still use up the bounds and are passed
    through, and are left out only at the end. What is found is a bounded list, so that no hop computes those before it again.
    """
    edges = edges.where(at_time(t))
    frontier = seeds if isinstance(seeds, list) else [r.id for r in seeds.select("id").collect()]  # seeds_max at most
    seen, found = set(frontier), []
    for hop in range(1, hops + 1):
        room = min(p.hop_top_k, p.max_neighbors - len(found))
        if not frontier or room <= 0:
            break
        new = step(frontier, edges, max(p.fanout, p.hop_top_k)).where(~F.col("neighbor").isin(list(seen)))
        best = new.groupBy(F.col("neighbor").alias("id")).agg(F.max("w").alias("w"), F.array_sort(F.array_compact(F.collect_set("via"))).alias("vias"))
        rows = best.orderBy(F.desc("w"), "id").limit(room).collect()
        found += [(r.id, hop, r.w, r.vias) for r in rows]
        frontier = [r.id for r in rows]
        seen.update(frontier)
    shown = memories.where(((current() & live()) if t is None else (as_of(t) & live(True))) & visible_to(caller)).where(F.col("id").isin([x[0] for x in found]) if found else F.lit(False)).select("id")
    return edges.sparkSession.createDataFrame(found, FOUND).join(shown, "id", "left_semi")


def neighbors(seed: int, edges: DataFrame, memories: DataFrame, entities: DataFrame, hops: int = 2, t: Column | None = None, etype: str | None = None, limit: int = 2000) -> DataFrame:
    """id, hop, kind, label, parent, relation, tree and truncated of what is within `hops` (1 to 4) of a memory or entity, links being walked both ways.

    hop is the least one; parent and relation are those of the least parent and edge that lead there on it, and tree says whether the parent is visible too. The first
    `limit` by hop and id are taken, truncated says whether there were as many; then memories that are not visible (current and live, or valid at t) are left out; entities
    always are visible. Each hop is a frontier joined to the edges and written out, whatever its size.
    """
    e = edges.where(at_time(t) & (F.lit(True) if etype is None else F.col("etype") == etype))
    links = e.select(F.col("id").alias("edge"), "etype", F.col("src").alias("a"), F.coalesce("dst", "entity_id").alias("b"))
    links = links.unionByName(links.select("edge", "etype", F.col("b").alias("a"), F.col("a").alias("b")))
    spark = edges.sparkSession
    seen = frontier = spark.createDataFrame([(seed, 0, None, None)], "id long, hop int, parent long, relation string")
    for hop in range(1, max(1, min(4, hops)) + 1):
        new = links.join(frontier.select(F.col("id").alias("a")), "a").join(seen.select(F.col("id").alias("b")), "b", "left_anti")
        frontier = cut(new.groupBy(F.col("b").alias("id")).agg(F.min(F.struct("a", "edge", "etype")).alias("m")).select("id", F.lit(hop).alias("hop"), F.col("m.a").alias("parent"), F.col("m.etype").alias("relation")))
        seen = seen.unionByName(frontier)
    first = seen.where("hop > 0").orderBy("hop", "id").limit(limit)
    first = cut(first.withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) >= limit))  # `limit` rows at most
    show = (current() & live()) if t is None else as_of(t)
    nodes = memories.select("id", F.col("title").alias("label"), F.lit("memory").alias("kind"), show.alias("shown")).unionByName(entities.select("id", F.col("name").alias("label"), F.lit("entity").alias("kind"), F.lit(True).alias("shown")))
    mine = nodes.where("shown").join(F.broadcast(first), "id")  # `limit` rows at most
    ids = mine.select(F.col("id").alias("parent"), F.lit(True).alias("tree")).unionByName(spark.createDataFrame([(seed, True)], "parent long, tree boolean"))
    return mine.join(F.broadcast(ids), "parent", "left").select("id", "hop", "kind", "label", "parent", "relation", F.coalesce("tree", F.lit(False)).alias("tree"), "truncated")


def factors(found: DataFrame, edges: DataFrame, memories: DataFrame, vectors: DataFrame, entities: DataFrame, query: Column, p: Params = DEFAULT) -> DataFrame:
    """found (see expand()) with factor: disambiguation_penalty where all its vias lose against an entity of the same name that stands nearer to the query, else 1."""
    vias = sorted({v for r in found.select("vias").collect() for v in r.vias})  # of max_neighbors rows
    lost = []
    if len(vias) > 1:
        own = entities.where(F.col("id").isin(vias))
        lost = [r.entity_id for r in losers(centroids(edges.where(F.col("entity_id").isin(vias)), memories, vectors, own, query, p), p.disambiguation_margin).collect()]
    penalised = (F.size("vias") > 0) & F.forall("vias", lambda v: v.isin(lost)) if lost else F.lit(False)
    return found.withColumn("factor", F.when(penalised, p.disambiguation_penalty).otherwise(1.0))


def centroids(edges: DataFrame, memories: DataFrame, vectors: DataFrame, entities: DataFrame, query: Column, p: Params = DEFAULT) -> DataFrame:
    """entity_id, name and cosine of the query to the mean vector of up to disambiguation_sample of the entity's visible memories (by edge id).

    The mean is taken by dimension: a hub's vectors are never gathered, only its sample is.
    """
    near = edges.where(F.col("entity_id").isNotNull() & current()).join(memories.where(current() & live()).select(F.col("id").alias("src")), "src", "left_semi").join(vectors.select(F.col("id").alias("src"), "embedding"), "src")
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("entity_id").orderBy("id"))).where(F.col("n") <= p.disambiguation_sample)
    mean = near.select("entity_id", F.posexplode("embedding").alias("d", "x")).groupBy("entity_id", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = mean.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("centroid"))
    return whole.join(entities.select(F.col("id").alias("entity_id"), "name"), "entity_id").select("entity_id", "name", F.round(cosine(F.col("centroid"), query), 6).alias("cos"))


def losers(cosines: DataFrame, margin: float = DEFAULT.disambiguation_margin) -> DataFrame:
    """Of entities with one name (lower case), those whose cosine is more than margin below the best."""
    w = Window.partitionBy(F.lower("name"))
    return cosines.withColumn("best", F.max("cos").over(w)).withColumn("n", F.count(F.lit(1)).over(w)).where((F.col("n") > 1) & (F.col("best") - F.col("cos") > margin)).select("entity_id", "name", "cos")


def chain(memories: DataFrame, seed: int, most: int = 5) -> DataFrame:
    """The versions before and after the seed, up to `most` (1 to 20) each way, oldest first: position, hop_from_seed, id, excerpt (500 characters) and truncated (of its text), with
    the flags cycle, more_ahead and more_back on each row. A version that was met is not walked through again. A frontier is a list; one look-up for each hop.
    """
    most = max(1, min(20, most))
    link = memories.where("superseded_by IS NOT NULL").select("id", F.col("superseded_by").alias("next"))

    def walk(key: str, to: str) -> tuple[dict[int, int], bool, set[int]]:
        hop, frontier, cycle = {seed: 0}, [seed], False
        for k in range(1, most + 2):
            rows = [r[0] for r in link.where(F.col(key).isin(frontier)).select(to).distinct().collect()] if frontier else []
            cycle |= any(x in hop for x in rows)
            new = [x for x in rows if x not in hop]
            if k > most:
                return hop, cycle, set(new)
            hop |= dict.fromkeys(new, k)
            frontier = new
        return hop, cycle, set()

    ahead, turned, more_ahead = walk("id", "next")
    back, turned_back, more_back = walk("next", "id")
    order = sorted(back, key=lambda x: (-back[x], x))
    order += [x for x in sorted(ahead, key=lambda x: (ahead[x], x)) if x not in back]
    cycle = turned or turned_back or bool(set(back) & set(ahead) - {seed})
    rows = [(x, k, ahead[x] if x in ahead else -back[x], cycle, bool(more_ahead - set(back)), bool(more_back - set(ahead))) for k, x in enumerate(order)]
    found = memories.sparkSession.createDataFrame(rows, "id long, position int, hop_from_seed int, cycle boolean, more_ahead boolean, more_back boolean")
    text = F.coalesce("body", F.lit(""))
    return memories.where(F.col("id").isin(order)).select("id", F.left(text, F.lit(500)).alias("excerpt"), (F.length(text) > 500).alias("truncated")).join(found, "id")


def all_weak_pairs(memories: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """dim, src, dst: the weak pairs by domain, by owner and by each tag."""
    tagged = memories.withColumn("tag", F.explode("tags"))
    parts = [weak_pairs(rows, c, p).select(F.lit(d).alias("dim"), "src", "dst") for d, rows, c in (("domain", memories, "domain"), ("owner", memories, "owner"), ("tag", tagged, "tag"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def extract_candidates(memories: DataFrame, edges: DataFrame, tried: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """id of the visible memories of domains not excluded that have no entity yet and were not tried without a result (tried: id)."""
    rows = memories.where(current() & live() & ~F.coalesce(F.col("domain"), F.lit("")).isin(*excluded, "\0"))
    return rows.join(edges.where("entity_id IS NOT NULL").select(F.col("src").alias("id")), "id", "left_anti").join(tried.select("id"), "id", "left_anti").select("id")


def validate_extracted(proposed: DataFrame, memories: DataFrame) -> DataFrame:
    """Proposed edges (src, dst, name, etype, weight) with verdict: source or target (no such memory), loop, etype, weight (not above 0), else accepted."""
    ids = memories.select("id")
    rows = proposed.join(ids.select(F.col("id").alias("s")), F.col("src") == F.col("s"), "left").join(ids.select(F.col("id").alias("d")), F.col("dst") == F.col("d"), "left")
    verdict = F.when(F.col("s").isNull(), "source").when((F.col("dst").isNull() & (F.trim(F.coalesce("name", F.lit(""))) == "")) | (F.col("dst").isNotNull() & F.col("d").isNull()), "target")
    verdict = verdict.when(F.col("src").eqNullSafe(F.col("dst")), "loop").when(~F.coalesce(F.col("etype").isin(*EDGE_TYPES), F.lit(False)), "etype").when(~F.coalesce(F.col("weight") > 0, F.lit(False)), "weight").otherwise("accepted")
    return rows.withColumn("verdict", verdict).drop("s", "d")


def upsert_entities(named: DataFrame, entities: DataFrame) -> DataFrame:
    """etype and name of the entities (name, etype) that are new: one for each type and trimmed name in either case, the least spelling; an unknown type is other."""
    etype = F.when(F.col("etype").isin(*ENTITY_TYPES), F.col("etype")).otherwise("other")
    new = named.where(F.trim("name") != "").select(etype.alias("etype"), F.trim("name").alias("name")).withColumn("key", F.lower("name"))
    known = entities.select("etype", F.lower(F.trim("name")).alias("key"))
    return new.groupBy("etype", "key").agg(F.min("name").alias("name")).join(known, ["etype", "key"], "left_anti").select("etype", "name")


def weak_pairs(memories: DataFrame, group: str, p: Params = DEFAULT) -> DataFrame:
    """src, dst: each of the weak_group latest rows of a group is linked to the next weak_k by recency."""
    w = Window.partitionBy(group).orderBy(F.desc("updated_at"), F.asc("id"))
    rows = memories.where(current() & live()).select("id", group, "updated_at").withColumn("n", F.row_number().over(w)).where(F.col("n") <= p.weak_group)
    after = rows.withColumn("next", F.array_compact(F.array(*[F.lead("id", k).over(w) for k in range(1, p.weak_k + 1)]))).withColumn("dst", F.explode("next"))
    return after.select(F.least("id", "dst").alias("src"), F.greatest("id", "dst").alias("dst")).distinct()
