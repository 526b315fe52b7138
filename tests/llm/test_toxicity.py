import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnesis.llm import queries
from mnesis.llm.common import token_hashes
from mnesis.llm.toxicity import PREFIXES, fit, fit_ordinal, score_toxicity, severity_grades

SF = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


def test_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    third = F.col("doc_id") % 3 == 0
    got = score_toxicity(docs, labels.where(~third)).toPandas().merge(labels.where(third).toPandas(), on="doc_id")
    bad = got.toxic_y == 1
    assert got[bad].toxic_x.mean() > 0.9
    assert got[~bad].toxic_x.mean() < 0.01
    assert got.severity.between(0, got.grade.max() + 1).all()


def test_whole_table(spark):
    got = queries.op3_toxicity(spark, "/root/testdata/sf0.01").toPandas()
    assert len(got) == 1000
    assert got.toxic.equals(got.grade.ge(1) | got.toxic)


def test_ordered_thresholds_share_weights():
    rng = np.random.default_rng(0)
    texts = [np.unique(np.concatenate([rng.integers(100, 2000, 30), np.arange(k)])).astype(np.uint64) for k in rng.integers(0, 4, 600)]
    grades = np.array([int((t < 3).sum()) for t in texts])
    model = fit_ordinal(texts, [np.ones(len(t)) for t in texts], grades, 4)
    assert (np.diff(model.thresholds) >= 0).all()
    z = model.linear(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    means = [z[grades == g].mean() for g in range(4)]
    assert means == sorted(means)


def test_grades_follow_the_number_of_markers():
    texts = [np.arange(i % 7, dtype=np.uint64) for i in range(70)] + [np.arange(50, 60, dtype=np.uint64)] * 60
    toxic = np.arange(130) < 70
    g = severity_grades(texts, toxic)
    assert (g[~toxic] == 0).all() and (g[toxic] >= 1).all()
    assert g[6] > g[1]


def test_odd_rows(spark, documents):
    rows = [(i, ("you vile fool number " if i % 3 == 0 else "a kind word number ") + "".join(chr(97 + int(c)) for c in str(i))) for i in range(120)]
    odd = [(500, None), (501, ""), (502, "fine words " * 50_000), (503, "VILE! fool."), (503, "VILE! fool."), (None, "vile fool")]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)] + [(7, 1, None), (None, 1, 1), (9999, 0, 1), (6, 0, 0)], LABELS)
    got = score_toxicity(documents(rows + odd), labels).collect()
    assert len(got) == 126
    assert {r.doc_id for r in got if r.toxic} == {None, 503} | {i for i in range(120) if i % 3 == 0}
    assert [r.severity for r in got if r.doc_id in (500, 501)] == [0, 0]
    assert score_toxicity(documents([]), labels).collect() == []
    assert [r.severity for r in score_toxicity(documents(rows[:1]), labels.limit(0)).collect()] == [0]


def test_severity_equals_the_formula_and_repeated_rows_teach_no_more(spark, documents):
    rows = [(i, ("you vile fool number " if i % 3 == 0 else "a kind word number ") + "".join(chr(97 + int(c)) for c in str(i))) for i in range(120)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)], LABELS)
    model = fit(documents(rows), labels)
    again = fit(documents(rows + [rows[4]] * 500), labels)
    assert (model.features == again.features).all() and np.allclose(model.weights, again.weights)
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    got = {r.doc_id: r for r in score_toxicity(documents(rows), labels).collect()}
    for i, text in rows:
        tokens, _ = token_hashes(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), PREFIXES)
        z = sum(weight.get(x, 0.0) * math.log2(1 + n) for x, n in Counter(tokens.tolist()).items())
        p = [1 / (1 + math.exp(t - z)) for t in model.thresholds]
        grades = [a - b for a, b in itertools.pairwise([1.0, *p, 0.0])]
        assert got[i].severity == pytest.approx(sum(p), abs=1e-9) and got[i].grade == int(np.argmax(grades))
        assert got[i].toxic == (p[0] >= 0.5)
