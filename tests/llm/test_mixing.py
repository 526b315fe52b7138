import re

import numpy as np
import pandas as pd
import pytest

from mnesis.llm import mixing, queries
from mnesis.llm.mixing import block_size, mix_sources, schedule, water_fill

SF = "/root/testdata/sf0.01"


def plain_targets(sizes, weights, most):
    """Share by weight, cut at most times the size, share the excess anew, until nothing is above."""
    target, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] > most * sizes[i]}
        if not over:
            for i in free:
                target[i] = share[i]
            break
        for i in over:
            target[i] = most * sizes[i]
            left -= target[i]
        free -= over
    return target


def test_targets_equal_repeated_sharing():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = rng.integers(1, 12)
        sizes = (rng.integers(0, 1000, n) * rng.integers(0, 2, n) + rng.integers(0, 5, n)).tolist()
        if sum(sizes):
            weights = [1 + i % 3 for i in range(n)]
            assert water_fill(sizes, weights, 3) == pytest.approx(plain_targets(sizes, weights, 3))


def test_every_stretch_of_the_schedule_has_each_source_near_its_share():
    source, rank = schedule([1000, 2000, 500], 1)
    assert len(source) == 3500 and np.abs(np.bincount(source) - [1000, 2000, 500]).max() <= 3
    for n in (50, 500, 3000):
        share = np.bincount(source[:n], minlength=3) / n
        assert np.abs(share - np.array([1000, 2000, 500]) / 3500).max() < 4 / n
    assert all(sorted(rank[source == s]) == list(range((source == s).sum())) for s in range(3))


def test_no_source_is_more_than_a_few_blocks_off():
    rng = np.random.default_rng(3)
    for _ in range(50):
        targets = rng.pareto(1.0, rng.integers(2, 40)) * 1000 + 1
        block = block_size(targets, 1 << 12)
        got = np.bincount(schedule(targets, block)[0], minlength=len(targets)) * block
        assert np.abs(got - targets).max() <= 5 * block
        assert block <= max(1, targets.min() / 64, np.ceil(targets.sum() / (1 << 15)))


def walked(docs, order, block):
    """What each document gives, slot by slot: the words of the r-th block of a source, its documents coming round again."""
    docs = docs.assign(words=docs.text.map(lambda t: len((t or "").split())))
    names = sorted(docs.source.unique())
    sizes = [int(docs.words[docs.source == s].sum()) for s in names]
    targets = plain_targets(sizes, [1 + i % 3 for i in range(len(names))], 3)
    taken, first = dict.fromkeys(docs.doc_id, 0), {}
    owner = [np.repeat([d for d in order if d in mine], [mine[d] for d in order if d in mine]) for mine in (dict(zip(x.doc_id, x.words, strict=True)) for x in (docs[docs.source == s] for s in names))]
    edges, at = np.cumsum(targets), [0] * len(names)
    for k in range(int(np.ceil(edges[-1] / block))):
        s = min(int(np.searchsorted(edges, (k * mixing.GOLDEN % 2**32) / 2**32 * edges[-1], "right")), len(names) - 1)
        for _ in range(block):
            if at[s] < 3 * sizes[s]:
                d = int(owner[s][at[s] % sizes[s]])
                taken[d] += 1
                first.setdefault(d, k)
                at[s] += 1
    return taken, first


def in_order(spark, docs):
    rows = spark.createDataFrame(docs[["doc_id", "text"]]).selectExpr("doc_id", "xxhash64(doc_id, text, 1) AS h").collect()
    return [r.doc_id for r in sorted(rows, key=lambda r: ((r.h >> 8) % 256, r.h))]


@pytest.mark.parametrize("golden", [mixing.GOLDEN, 1 << 20])
def test_taken_equals_a_walk_through_the_slots_and_depends_on_the_points(spark, monkeypatch, golden):
    docs = pd.read_parquet(f"{SF}/documents.parquet").head(150)
    docs["source"] = docs.doc_id.map(lambda i: f"s{i % 4 if i % 7 else 9}")
    frame = spark.createDataFrame(docs)
    usual = {r.doc_id: r.taken for r in mix_sources(frame, slots=1 << 9).collect()}
    own = golden == mixing.GOLDEN
    monkeypatch.setattr(mixing, "GOLDEN", golden)
    sizes = [int(x.text.map(lambda t: len(t.split())).sum()) for _, x in docs.groupby("source")]
    taken, first = walked(docs, in_order(spark, docs), block_size(plain_targets(sizes, [1 + i % 3 for i in range(len(sizes))], 3), 1 << 9))
    if own:
        assert usual == taken
        assert {r.doc_id: r.first_slot for r in mix_sources(frame, slots=1 << 9).collect() if r.taken} == first
    else:
        assert usual != taken


def test_whole_table(spark):
    got = queries.op1_mixing(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/documents.parquet"), on="doc_id")
    assert len(got) == 1000
    assert (got["size"] == got.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))).all()
    by = got.groupby("source").agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum")).sort_index()
    assert (by["size"] == by.source_size).all()
    assert by.target.tolist() == pytest.approx(plain_targets(by["size"].tolist(), [1 + i % 3 for i in range(len(by))], 3))
    assert (by.taken - by.target).abs().max() <= 5 * block_size(by.target.tolist(), 1 << 18)
    assert (got.taken <= 3 * got["size"]).all()
    again = queries.op1_mixing(spark, SF).toPandas()
    lines = lambda x: sorted(tuple(None if v != v else v for v in r) for r in x.itertuples(index=False, name=None))
    assert sorted(map(str, lines(again))) == sorted(map(str, lines(got[again.columns])))


def test_odd_rows(spark, documents):
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "x y"), (4, "w " * 100_000), (5, "one")]
    sources = ["b", "b", "b", None, None, "a", "\U0001f600"]
    got = mix_sources(documents(rows, sources=sources), slots=64).collect()
    assert len(got) == len(rows)
    sizes = {"a": 100_000, "b": 6, "\U0001f600": 1, None: 2}
    assert all(r.source_size == sizes[r.source] for r in got)
    targets = [{r.source: r.target for r in got}[s] for s in sizes]
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 5 * block_size(targets, 64)
        assert all(r.taken <= 3 * r.size for r in mine)
    assert mix_sources(documents([])).collect() == []
    assert [r.taken for r in mix_sources(documents([(1, None)])).collect()] == [0]
