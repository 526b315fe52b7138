"""Connected components over a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnesis.llm.common import Scratch


def _with_minimum(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with m, the least of u and its neighbours. The join's key is a hash of u, so that both sides are exchanged for it and a hub's edges can be split."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(F.xxhash64("u").alias("k"), F.col("u").alias("c"), "m")
    own = edges.withColumn("k", F.xxhash64("u"))
    return own.join(least, (own.k == least.k) & (own.u == least.c)).select("u", "v", "m")


def connected_components(edges: DataFrame, scratch: Scratch, label: str = "components") -> DataFrame:
    """(node, component) for every node of edges (u, v), the component's name being its least node.

    Rounds of large-star and small-star turn each component into a star about its least node; their number grows with the logarithm of the nodes.
    Every round is a written table, and nothing but its count and checksum comes to the driver.
    """
    edges = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = scratch.save(edges, f"{label}-0")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen, k = mark(edges), 0
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_minimum(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = scratch.save(large.distinct(), f"{label}-{k}-large")
        small = _with_minimum(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v")
        k += 1
        scratch.save(small.distinct(), f"{label}-{k}")
        scratch.drop(f"{label}-{k - 1}", f"{label}-{k - 1}-large")
        edges = scratch.spark.read.parquet(scratch.path(f"{label}-{k}"))
        if (now := mark(edges)) == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
