import random
import re

import numpy as np
import pandas as pd
import pytest

from mnesis.llm import queries
from mnesis.llm.decontamination import Shares, find_leaks, lcs

SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\s!-/:-@\[-`{-~]+", text.lower())


def test_whole_table_finds_every_passage_and_no_clean_document(spark):
    got = queries.op6_decontamination(spark, SF).toPandas()
    docs, items = pd.read_parquet(f"{SF}/documents.parquet"), pd.read_parquet(f"{SF}/benchmark.parquet")
    texts = {i: " ".join(words(t)) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    want = {(d, i) for i, t in zip(items.item_id, items.text, strict=True) for d, x in texts.items() if " ".join(words(t)) in x}
    found = set(zip(got.doc_id, got.item_id, strict=True))
    assert len(want & found) >= 0.95 * len(want) > 20
    item = dict(zip(items.item_id, items.text, strict=True))
    for d, i in found - want:
        assert lcs(words(item[i]), words(docs.text[docs.doc_id == d].iloc[0])) >= 0.6 * len(words(item[i]))


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs_equals_the_table():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (rng.integers(0, 6, rng.integers(1, 70)).tolist() for _ in range(2))
        assert lcs(a, b) == plain_lcs(a, b)


def test_paraphrases_answers_and_odd_rows(spark, documents):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    noise = lambda n: " ".join(rng.choice(["the", "of", "and", word()]) for _ in range(n))
    items = [(i, " ".join(word() for _ in range(30)) + ". The answer is " + " ".join(word() for _ in range(4)) + ".") for i in range(20)]
    rows = [(i, noise(200)) for i in range(100)]
    def changed(text, share):
        return " ".join(word() if rng.random() < share else w for w in text.split())
    rows[3] = (3, noise(90) + " " + items[5][1].upper() + " " + noise(90))
    rows[4] = (4, noise(30_000) + " " + changed(items[6][1], 0.15) + " " + noise(50))
    question, _, answer = items[7][1].partition(". ")
    rows[8] = (8, noise(80) + " " + question + " " + noise(80))  # without its answer
    rows += [(3, rows[3][1]), (500, None), (501, ""), (502, " . ! "), (None, items[9][1])]
    benchmark = spark.createDataFrame([*items, (50, None), (51, "?!"), (None, "x")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(documents(rows), benchmark).collect()}
    assert got == {(3, 5), (4, 6), (None, 9)}
    assert {(r.doc_id, r.item_id) for r in find_leaks(documents(rows), benchmark, item_block=7).collect()} == got
    own = spark.createDataFrame([(i, t, "zzz qqq") for i, t in items], "item_id long, text string, answer string")
    assert find_leaks(documents(rows), own).collect() == []
    assert find_leaks(documents([]), benchmark).collect() == []
    assert find_leaks(documents(rows), benchmark.limit(0)).collect() == []


def planted(length, n, change, seed):
    """n items of `length` words and documents that each hold one changed item (item i in document i), then as many without any."""
    rng = random.Random(seed)
    zipf = [f"w{k}" for k in range(400)]
    common = lambda: zipf[min(399, int(rng.paretovariate(0.6)) - 1)]
    word = lambda: common() if rng.random() < 0.5 else "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    items = [[word() for _ in range(length)] for _ in range(n)]
    noise = lambda k: [word() for _ in range(k)]
    docs = [noise(rng.randint(0, 150)) + change(x, rng, word) + noise(rng.randint(0, 150)) for x in items] + [noise(250) for _ in range(n)]
    return [(i, " ".join(x)) for i, x in enumerate(items)], [(i, " ".join(x)) for i, x in enumerate(docs)]


def swapped(x, rng, word):
    """65 % of the words stay; the last ones, the answer, do."""
    gone = set(rng.sample(range(len(x) - 4), int(0.35 * len(x))))
    return [word() if k in gone else w for k, w in enumerate(x)]


def shortened(x, rng, word):
    gone = set(rng.sample(range(len(x) - 4), int(0.35 * len(x))))
    return [w for k, w in enumerate(x) if k not in gone]


def stretched(x, rng, word):
    """65 % of the words stay, with two in five new ones between."""
    return [y for w in shortened(x, rng, word) for y in ([w, word()] if rng.random() < 0.4 else [w])]


@pytest.mark.parametrize("length", [16, 40, 100, 300])
@pytest.mark.parametrize("change", [lambda x, *_: x, swapped, shortened, stretched], ids=["verbatim", "swapped", "shortened", "stretched"])
def test_items_of_any_length_and_their_65_percent_paraphrases_are_found(spark, documents, length, change):
    items, rows = planted(length, 40, change, length)
    answered = spark.createDataFrame([(i, t, " ".join(t.split()[-4:])) for i, t in items], "item_id long, text string, answer string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(documents(rows), answered).collect()}
    held = dict(items)
    for d, i in got:
        assert plain_lcs(held[i].split(), rows[d][1].split()) >= 0.6 * length
    assert sum((i, i) in got for i in range(40)) >= 38


@pytest.mark.parametrize("change", [lambda x, *_: x, swapped], ids=["verbatim", "swapped"])
def test_items_of_2000_words_are_found(spark, documents, change):
    items, rows = planted(2000, 12, change, 9)
    answered = spark.createDataFrame([(i, t, " ".join(t.split()[-4:])) for i, t in items], "item_id long, text string, answer string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(documents(rows), answered).collect()}
    assert got == {(i, i) for i in range(12)}


def test_the_bound_is_never_below_the_subsequence_and_both_ways_agree():
    rng = np.random.default_rng(5)
    items = [rng.integers(1, 40, n).astype(np.int32) for n in (3, 10, 40, 1)]
    codes = np.where(rng.random(500) < 0.3, 0, rng.integers(1, 40, 500)).astype(np.int32)
    a = rng.integers(0, 450, 60)
    b, i = a + rng.integers(0, 50, 60), rng.integers(0, 4, 60)
    dense, sparse = Shares(items, 40).bounds(codes, a, b, i, step=64), Shares(items, 40, dense=0).bounds(codes, a, b, i)
    assert (dense == sparse).all()
    for x, y, k, most in zip(a, b, i, dense, strict=True):
        assert most >= lcs(items[k].tolist(), codes[x:y].tolist())
        assert most == sum(min((items[k] == c).sum(), (codes[x:y] == c).sum()) for c in range(1, 40))
