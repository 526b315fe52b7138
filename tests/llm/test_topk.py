import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from mnesis.llm import queries
from mnesis.llm.topk import PivotTable, choose_pivots, search_block, top_k

SF = "/root/testdata/sf0.01"


def plain(rows, k, every):
    out = []
    for q in sorted({i for i, x in rows if i % every == 0}):
        x = min(v for i, v in rows if i == q)
        scored = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in rows if i != q)  # noqa: B905
        out += [(q, n, i, int(-s)) for n, (s, i) in enumerate(scored[:k], 1)]
    return out


def test_whole_table_equals_brute_force(spark):
    table = pd.read_parquet(f"{SF}/embeddings.parquet")
    rows = [(int(i), np.floor(64 * e.astype(float)).tolist()) for i, e in zip(table.vec_id, table.embedding, strict=True)]
    got = sorted(tuple(r) for r in queries.op7_topk(spark, SF).collect())
    assert got == plain(rows, 20, 20)


def test_odd_vectors_ties_and_several_blocks(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5)]) for i in range(200)]
    rows += [(300 + i, [1.0, 2.0, 0.0, 0.0, 0.0]) for i in range(60)] + [(0, rows[0][1]), (7, rows[9][1]), (400, [1.0, 2.0]), (401, [])]
    odd = [(500, None), (501, [1.0, None]), (502, [float("nan")]), (503, [float("-inf"), 1.0]), (None, [1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, x array<double>")
    for block in (4096, 5):
        got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 10 == 0, k=12, pivots=5, sample=40, query_block=block, rows=50).collect())
        assert got == plain(rows, 12, 10)
    few = spark.createDataFrame(rows[:3], "vec_id long, x array<double>")
    assert sorted(tuple(r) for r in top_k(few, F.col("vec_id") % 10 == 0, k=12).collect()) == plain(rows[:3], 12, 10)
    assert top_k(few.limit(0), F.col("vec_id") % 10 == 0).collect() == []


def test_bounds_hold_and_eliminate():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 20, (30, 16))
    x = np.floor(centres[rng.integers(0, 30, 4000)] + rng.normal(0, 1, (4000, 16)))
    q = x[::100]
    table = PivotTable(choose_pivots(rng.permutation(x)[:500], 100), (x**2).sum(1).max())
    to_query, to_x = table.distances(q, False).astype(np.float32), table.distances(x, True).astype(np.float32).T.copy()
    for i in range(len(q)):
        assert (table.upper((q[i] ** 2).sum(), to_query[i], to_x, 6) >= x @ q[i]).all()
    best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in q]
    n = search_block(np.arange(0, 4000, 100), q, best, table, to_query, np.arange(4000), x, 10)
    assert n < 0.3 * len(q) * len(x)
