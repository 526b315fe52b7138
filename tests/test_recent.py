import math
import time
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnesis.functions.columns import cosine, days
from mnesis.operators import recent, writes

ROWS = "id long, bank string, embedding array<double>, hours int"


def frame(spark, rows):
    return spark.createDataFrame(rows, ROWS).repartition(5).select("id", "bank", "embedding", F.expr("timestampadd(HOUR, hours, TIMESTAMP_NTZ '2024-01-01')").alias("created_at"))


def all_pairs(batch, known, least):
    """The rule, a pair at a time."""
    k = known.select(F.col("id").alias("existing"), F.col("bank").alias("bank2"), F.col("embedding").alias("v"), F.col("created_at").alias("at2"))
    near = batch.join(k, (F.col("bank") == F.col("bank2")) & (F.col("existing") != F.col("id")) & (F.col("at2") <= F.col("created_at")) & (F.col("at2") > F.col("created_at") - days(F.lit(3))))
    best = near.withColumn("cos", F.round(cosine(F.col("embedding"), F.col("v")), 6)).where(F.col("cos") >= least)
    out = best.groupBy("id").agg(F.max(F.struct("cos", (-F.col("existing")).alias("minus"))).alias("m")).select("id", -F.col("m.minus"), "m.cos")
    return sorted((a, b, repr(c)) for a, b, c in out.collect())


@pytest.mark.parametrize(("least", "most"), [(0.1, 5), (0.6, 17), (0.95, 4096)])
def test_blocks_equal_all_pairs(spark, least, most):
    """Copies in and out of the window, hot days, several dimensions, and vectors that are odd."""
    r = np.random.default_rng(most)
    v = r.integers(-3, 4, (260, 6)).astype(float)
    v[100:260:4] = v[3]
    v[200:230] += r.normal(size=(30, 6)) * 1e-7
    hours = np.where(r.random(260) < 0.5, 50, r.integers(0, 240, 260))
    rows = [(i, "ab"[i % 3 == 0], [float(x) for x in v[i]], int(hours[i])) for i in range(260)]
    rows += [(300, "a", [0.0] * 6, 50), (301, "a", [1.0, math.nan, 0.0, 0.0, 0.0, 0.0], 51), (302, "a", [1.0, None, 0.0, 0.0, 0.0, 0.0], 50), (303, "a", None, 50), (304, "a", [1.0, 2.0], 50), (305, "a", [1.0, 2.1], 51), (306, "a", [], 50), (307, None, [1.0] * 6, 50), (308, "b", [math.inf] * 6, 300), (309, "b", [1.0] * 6, 301)]
    batch = frame(spark, rows)
    known = batch.where("id % 4 < 3 OR id >= 300")
    got = sorted((a, b, repr(c)) for a, b, c in writes.semantic_duplicates(batch, known, least=least, most=most).collect())
    assert got == all_pairs(batch, known, least) and len(got) > 60
    assert writes.semantic_duplicates(batch, known.limit(0)).collect() == []


def test_a_hot_day_is_dealt_out(spark):
    """8,000 rows of one bank and day: a pair at a time in one task took minutes."""
    r = np.random.default_rng(1)
    v = r.normal(size=(8000, 64))
    v[4000:] = v[0]
    rows = frame(spark, [(i, "a", x, i % 20) for i, x in enumerate(v.tolist())])
    began = time.time()
    got = {r.id: (r.existing, r.cos) for r in writes.semantic_duplicates(rows, rows, least=0.9).collect()}
    assert time.time() - began < 25
    assert got == {i: (0, 1.0) if i else (4000, 1.0) for i in [0, *range(4000, 8000)]}


def test_rounding_is_that_of_decimals():
    r = np.random.default_rng(2)
    x = np.concatenate([r.uniform(-1, 1, 3000), (2 * r.integers(-(10**6), 10**6, 3000) + 1) / 2e6, np.nextafter((2 * r.integers(0, 10**6, 3000) + 1) / 2e6, 0)])
    want = [float(Decimal(repr(float(y))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for y in x]
    assert recent.rounded(x).tolist() == want
