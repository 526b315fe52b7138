"""Positions in a global order, by range partitions and offsets of theirs, and joins that spread hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnesis.llm.common import Scratch, shuffle_partitions

_ROW = (1 << 33) - 1  # a row's place in its partition, as monotonically_increasing_id() packs it


def numbered(df: DataFrame, order: list[Column | str], scratch: Scratch, label: str, name: str = "position") -> DataFrame:
    """The rows with their 0-based position in the order, as a written table; tasks hold ranges of the order, so that no key's rows need to meet in one.

    Rows alike in all of `order` share a task. What is added up in one place is a count for each task.
    """
    n = shuffle_partitions(scratch.spark)
    ranges = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = scratch.save(ranges.select("*", F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW)).alias("_row")), label)
    sizes = rows.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_task", (F.sum("_n").over(Window.orderBy("_task")) - F.col("_n")).alias("_before"))
    # as many rows as there were tasks
    return rows.join(F.broadcast(before), "_task").select(*df.columns, (F.col("_before") + F.col("_row")).alias(name))


def running_sums(df: DataFrame, position: str, values: list[str], scratch: Scratch, label: str, block: int = 4096) -> DataFrame:
    """The rows with sum_<value>: the sum of each value over all rows up to and with this one, by position (0-based and dense), as a written table.

    Blocks of `block` positions are summed up, then blocks of blocks, until one is left; each level's sums start where the level above says.
    """
    at = F.expr(f"{position} div {block}")
    sums = df.groupBy(at.alias(position)).agg(*(F.sum(v).alias(v) for v in values))
    more = df.agg(F.max(position)).first()[0]
    if more is not None and more >= block:
        above = running_sums(scratch.save(sums, f"{label}-in"), position, values, scratch, f"{label}-up", block)
        start = above.select(F.col(position).alias("_block"), *((F.col(f"sum_{v}") - F.col(v)).alias(f"_before_{v}") for v in values))
        rows = df.withColumn("_block", at).join(start, "_block")
    else:
        rows = df.select("*", F.lit(0).cast("long").alias("_block"), *(F.lit(0).cast("long").alias(f"_before_{v}") for v in values))
    w = Window.partitionBy("_block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return scratch.save(rows.select(*df.columns, *((F.col(f"_before_{v}") + F.sum(v).over(w)).alias(f"sum_{v}") for v in values)), label)


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, salts: int = 64, how: str = "inner") -> DataFrame:
    """left joined to right, whose key is unique, with the rows of a hot key of left spread over `salts` tasks by a hash of another column.

    right is repeated for those salts alone that the key's rows have, so at most once for each row of left.
    """
    left = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    dealt = right.join(left.select(key, "_salt").distinct(), key)
    return left.join(dealt, [key, "_salt"], how).drop("_salt")
