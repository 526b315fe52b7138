import numpy as np
import pytest
from pyspark.sql import functions as F

from mnesis.operators.retrieval import vector_route
from mnesis.operators.vectorindex import indexed_vector_route, vector_index_build

ROWS = "id long, bank string, embedding array<float>"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """Clouds of copies and near ones; rows without a usable vector."""
    r = np.random.default_rng(8)
    c = r.normal(size=(20, 12))
    v = c[r.integers(0, 20, 1500)] + 0.15 * r.normal(size=(1500, 12))
    v[700:760] = v[3]
    rows = [(i, "abc"[i % 3], [float(x) for x in y]) for i, y in enumerate(v)] + [(2000, "a", None), (2001, "a", [0.0] * 12), (2002, None, [1.0] * 12), (2003, "b", [float("inf")] + [0.0] * 11)]
    path = f"file://{tmp_path_factory.mktemp('v')}/i"
    frame = spark.createDataFrame(rows, ROWS).repartition(6)
    vector_index_build(frame, path, cells=20)
    return frame, path, v


def test_exact_search_equals_the_scan(spark, index):
    frame, path, v = index
    plain = frame.where("id < 2000")
    read = []
    for k, (visible, bank) in enumerate([(F.lit(True), None), (F.col("id") % 7 != 0, "b"), (F.col("id") > 1400, None)]):
        want = vector_route(plain if bank is None else plain.where(F.col("bank") == bank), plain.drop("bank"), v[3 + 50 * k], 25, visible)
        got, cells = indexed_vector_route(spark, path, v[3 + 50 * k], frame, visible, 25, bank)
        assert [tuple(r) for r in got.orderBy("rank").collect()] == [tuple(r) for r in want.orderBy("rank").collect()]
        read.append(cells["read"] / cells["cells"])
    assert read[0] < 0.4 and read[1] < 0.4


def test_probing_recall(spark, index):
    frame, path, v = index
    hits = total = 0
    for i in (5, 111, 222, 999):
        want = {r.id for r in indexed_vector_route(spark, path, v[i], frame, F.lit(True), 20)[0].collect()}
        got, cells = indexed_vector_route(spark, path, v[i], frame, F.lit(True), 20, probe=6)
        assert cells == {"cells": cells["cells"], "read": 6} and cells["cells"] > 40
        hits, total = hits + len(want & {r.id for r in got.collect()}), total + len(want)
    assert hits / total >= 0.9


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    empty = spark.createDataFrame([], ROWS)
    vector_index_build(empty, path)
    assert indexed_vector_route(spark, path, [1.0], empty, F.lit(True))[0].collect() == []
