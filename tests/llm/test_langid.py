import random
import zlib

import numpy as np
import pandas as pd
import pytest

from mnesis.llm import queries
from mnesis.llm.langid import cut_windows, fit, identify, predict, train

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_on_the_whole_table(spark):
    got = queries.op2_langid(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "lang"]], on="doc_id")
    assert len(got) == 1000
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97


def test_no_input_but_text_and_odd_rows(spark, documents):
    rng = random.Random(0)
    vocab = {"aa": "ka lo mi nu pa".split(), "bb": "zrx qvt wyk hgd jst".split()}
    rows, langs = [], []
    for i in range(300):
        lang = rng.choice(["aa", "bb"])
        rows.append((i, " ".join(rng.choice(vocab[lang]) for _ in range(rng.randint(4, 60)))))
        langs.append(lang)
    rows += [(1000, None), (1001, ""), (1002, "123 !?"), (1003, "zrx qvt " * 30_000), (None, "ka lo mi nu pa"), (1004, "pa nu mi"), (1004, "pa nu mi")]
    langs += ["aa", "bb", None, "aa", "bb", None, None]
    got = {}
    for r in identify(documents(rows, langs)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert all(got[i][0].lang_pred == "und" and got[i][0].score == 0 for i in (1000, 1001, 1002))
    assert got[1003][0].lang_pred == "bb"
    assert got[None][0].lang_pred == "aa"
    assert not got[None][0].held_out
    assert [x.lang_pred for x in got[1004]] == ["aa", "aa"]
    assert sum(got[i][0].lang_pred == langs[i] for i in range(300)) > 290
    assert identify(documents([])).collect() == []
    assert [r.lang_pred for r in identify(documents([(1, "ka lo")], [None])).collect()] == ["und"]


def test_probabilities_equal_a_plain_forward_pass():
    rng = np.random.default_rng(4)
    net = train(rng.integers(97, 123, (40, 16)).astype(np.uint8), np.arange(40) % 3, ["a", "b", "c"], widths=(2, 3), filters=4, epochs=1)
    windows = rng.integers(0, 256, (5, 16)).astype(np.uint8)
    for w, got in zip(windows, net.probabilities(windows), strict=True):
        pooled = [max(sum(t[k, w[i + k], f] for k in range(len(t))) for i in range(16 - len(t) + 1)) for t in net.tables for f in range(4)]
        z = np.maximum(np.array(pooled) + net.bias, 0) @ net.out + net.out_bias
        assert np.allclose(got, np.exp(z) / np.exp(z).sum(), atol=1e-5)


def test_a_document_scores_the_mean_of_its_windows(spark, documents):
    rng = random.Random(1)
    word = {"x": lambda: "".join(rng.choice("abcd") for _ in range(5)), "y": lambda: "".join(rng.choice("wxyz") for _ in range(5))}
    rows = [(i, " ".join(word["xy"[i % 2]]() for _ in range(rng.choice([3, 60, 300])))) for i in range(60)]
    docs = documents(rows, langs=["xy"[i % 2] for i in range(60)])
    net = fit(docs, window=64)
    for r in predict(docs, net).collect():
        raw = np.frombuffer(r.text.encode(), np.uint8)
        windows, _ = cut_windows(raw, np.array([0, len(raw)]), 64)
        mean = net.probabilities(windows).mean(0)
        assert (r.lang_pred, r.score) == (net.classes[int(mean.argmax())], pytest.approx(float(mean.max()), abs=1e-5))


def test_columns_that_a_prediction_has_too_are_replaced(spark, documents):
    docs = documents([(i, "abab cd" if i % 2 else "xyzx wz") for i in range(40)], langs=["x", "y"] * 20).selectExpr("*", "'old' AS score", "1 AS _letters", "2 AS lang_pred")
    got = predict(docs, fit(docs, window=32))
    assert sorted(got.columns) == sorted(docs.columns) and dict(got.dtypes)["score"] == "double" and got.first()._letters == 1
