import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnesis.operators import similar
from mnesis.operators.similar import greedy, retain_semantic, semantic_gate, usable


def unit(v):
    return np.asarray(v, float) / max(np.linalg.norm(v), 1e-300)


def cos(a, b):
    return math.floor(float(unit(a) @ unit(b)) * 1e6 + 0.5) / 1e6


def clouds(seed, n, spread=0.35, centres=12, dim=8):
    """Vectors around a few centres, some copies, ids in no order of theirs."""
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dim))
    v = c[r.integers(0, centres, n)] + spread * r.normal(size=(n, dim))
    v[n // 2 :: 5] = v[: len(v[n // 2 :: 5])]
    return [(i, "ab"[int(b)], [float(x) for x in row]) for i, b, row in zip(range(n), r.integers(0, 2, n), v, strict=True)]


def sequential(rows, least):
    kept = []
    for i, b, v in sorted(rows):
        if all(k[1] != b or cos(k[2], v) < least for k in kept):
            kept.append((i, b, v))
    return [k[0] for k in kept]


def frame(spark, rows, name="id"):
    return spark.createDataFrame(rows, f"{name} long, bank string, embedding array<double>").repartition(5)


@pytest.mark.parametrize(("seed", "least", "pivots", "most"), [(1, 0.9, 6, 10), (2, 0.8, 1, 7), (3, 0.97, 40, 4096)])
def test_join_equals_brute_force(spark, seed, least, pivots, most):
    left, right = clouds(seed, 150), [(1000 + i, b, v) for i, b, v in clouds(seed, 200, 0.3)]
    got = {r.id: (r.other, r.cos) for r in similar.similar(frame(spark, left).withColumn("least", F.lit(least)), frame(spark, right).withColumn("state", F.lit(0)), pivots=pivots, most=most).collect()}
    want = {}
    for i, b, v in left:
        near = sorted((-cos(v, w), j) for j, c, w in right if b == c and cos(v, w) >= least)
        if near:
            want[i] = (near[0][1], -near[0][0])
    assert got == want and len(want) > 20


def test_cells_spare_comparisons(spark):
    """Of well separated clouds a row goes to few of the cells."""
    rows = frame(spark, clouds(4, 400, 0.02, 10, 16))
    left = usable(rows).withColumns({"state": F.lit(0), "least": F.lit(0.98)})
    steer = similar.choose_pivots(left, 10)
    counts = similar._dealt(left, 0, steer, {}).groupBy("bank", "cell").count().collect()
    dealt = similar._dealt(left, 1, steer, {(r.bank, r.cell): 1 for r in counts}).count()
    assert dealt < 400 * len(counts) / 2 / 2


@pytest.mark.parametrize("seed", [5, 6])
def test_rounds_equal_the_sequential_rule(spark, seed):
    rows = clouds(seed, 160)
    got = sorted(r.id for r in greedy(frame(spark, rows).withColumn("least", F.lit(0.85)), finish=0, pivots=7, most=9).collect())
    assert got == sequential(rows, 0.85) and 20 < len(got) < 150
    assert sorted(r.id for r in greedy(frame(spark, rows).withColumn("least", F.lit(0.85)), finish=40).collect()) == got


def test_a_chain_in_order(spark):
    """Each is like the one before it only: every second stays, and each round decides two."""
    rows = [(i, "a", [math.cos(i * 0.4), math.sin(i * 0.4), 0.0]) for i in range(7)]
    assert sorted(r.id for r in greedy(frame(spark, rows).withColumn("least", F.lit(math.cos(0.5))), finish=0).collect()) == [0, 2, 4, 6]


def test_gate(spark):
    batch, old = clouds(7, 120), [(1000 + i, b, v) for i, b, v in clouds(7, 200, 0.3) if i % 4 == 0]
    batch += [(500, "a", None), (501, "a", [0.0] * 8), (502, None, batch[0][2]), (503, "a", [float("nan")] * 8)]
    got = {r.item: (r.existing, r.earlier, r.cos) for r in semantic_gate(frame(spark, batch, "item"), frame(spark, old), least=0.9, finish=5, most=16).collect()}
    sane = batch[:120]
    known = {i: sorted((-cos(v, w), 0, j) for j, c, w in old if b == c and cos(v, w) >= 0.9) for i, b, v in sane}
    stay = sequential([x for x in sane if not known[x[0]]], 0.9)
    want = {}
    for i, b, v in sane:
        near = sorted(known[i] + [(-cos(v, w), 1, j) for j, c, w in sane if i not in stay and j in stay and j < i and b == c and cos(v, w) >= 0.9])
        if near:
            want[i] = (near[0][2] if near[0][1] == 0 else None, near[0][2] if near[0][1] else None, -near[0][0])
    assert got == want and any(x[0] for x in want.values()) and any(x[1] for x in want.values())
    assert semantic_gate(frame(spark, [], "item"), frame(spark, [])).collect() == []


def test_gate_inside_retain(spark):
    """Banks have their own thresholds, and only recent current rows count."""
    at = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    v = lambda c: [c, math.sqrt(1 - c * c)]
    known = spark.createDataFrame([(1, "hermes", [1.0, 0.0], "2024-01-09", "trial"), (2, "knowledge", [1.0, 0.0], "2024-01-09", "trial"), (3, "hermes", [0.0, -1.0], "2024-01-01", "trial"), (4, "hermes", [-1.0, 0.0], "2024-01-09", "retired")], "id long, bank string, embedding array<double>, at string, ttl_state string")
    known = known.withColumns({"created_at": F.col("at").cast("timestamp_ntz"), "invalid_at": F.lit(None).cast("timestamp_ntz")})
    items = [(10, "hermes", v(0.96), "accepted"), (11, "knowledge", v(0.96), "accepted"), (12, "hermes", [0.0, -1.0], "accepted"), (13, "hermes", [-1.0, 0.0], "accepted"), (14, "hermes", [-1.0, 0.01], "accepted"), (15, "hermes", v(0.97), "exact"), (16, "hermes", None, "accepted")]
    result = spark.createDataFrame([(i, b, s, 77 if s == "exact" else None) for i, b, _, s in items], "item long, bank string, status string, existing long")
    got = retain_semantic(result, spark.createDataFrame([(i, e) for i, _, e, _ in items], "item long, embedding array<double>"), known, at)
    assert sorted((r.item, r.status, r.existing, r.earlier) for r in got.collect()) == [(10, "semantic", 1, None), (11, "accepted", None, None), (12, "accepted", None, None), (13, "accepted", None, None), (14, "semantic", None, 13), (15, "exact", 77, None), (16, "accepted", None, None)]


def test_the_sequential_rule_by_first_rows_of_each_bank(spark):
    """Few rows at once, so that many rounds are needed: the same rows stay as one by one."""
    import numpy as np

    from mnesis.operators import similar, writes

    rng = np.random.default_rng(3)
    rows = [(i, f"b{i % 3}", rng.normal(size=6).tolist(), 0.8) for i in range(300)]
    want = sorted(k for b in range(3) for k in writes.greedy_semantic([(i, v) for i, x, v, _ in rows if x == f"b{b}"], 0.8))
    frame = spark.createDataFrame(rows, "id long, bank string, embedding array<double>, least double")
    assert sorted(r.id for r in similar.greedy(frame, finish=5, size=40).collect()) == want
