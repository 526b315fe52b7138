import itertools
import random

import numpy as np
import pandas as pd
import xxhash

from mnesis.llm import queries
from mnesis.llm.common import Scratch
from mnesis.llm.simhash import covering_masks, hamming_links, near_duplicates

SF = "/root/testdata/sf0.01"


def plain_fingerprint(text, n):
    words = ("" if text is None else text).encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, ids, radius=4):
    f = np.array(fps, np.uint64)
    root = list(range(len(f)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= radius) + i + 1:
            root[find(int(j))] = find(i)
    best = {}
    for i, d in enumerate(ids):
        best[find(i)] = min(d, best.get(find(i), d))
    return [best[find(i)] for i in range(len(f))]


def test_masks_cover_every_pair_within_the_radius():
    masks = covering_masks(list(range(64)), 4, 0)
    assert len(masks) == 31
    assert all(20 <= bin(int(m)).count("1") <= 44 for m in masks)
    rng = random.Random(0)
    for _ in range(3000):
        flip = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(int(m) & flip == 0 for m in masks)


def test_whole_table_equals_brute_force(spark):
    got = queries.op10_simhash(spark, SF).toPandas().sort_values("doc_id")
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    fps = [plain_fingerprint(t, 4) for t in docs.text]
    assert got.fingerprint.tolist() == [f"{x:016x}" for x in fps]
    assert got.component_id.tolist() == plain_components(fps, docs.doc_id.tolist())


def test_large_buckets_are_dealt_anew_and_lose_no_link(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 400:
        fps.add(rng.choice(sorted(fps)) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 9))))
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x, x) for x in signed], "node long, fp long")
    links = hamming_links(df, Scratch(spark, "t"), most=4).toPandas()
    want = plain_components(fps, list(range(len(fps))))
    at = {x: i for i, x in enumerate(signed)}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for u, v in zip(links.u, links.v, strict=True):
        assert bin((u ^ v) & (2**64 - 1)).count("1") <= 4
        root[find(at[v])] = find(at[u])
    got = [find(i) for i in range(len(fps))]
    for i, j in itertools.combinations(range(len(fps)), 2):
        assert (want[i] == want[j]) == (got[i] == got[j])


def test_odd_rows(spark, documents):
    rows = [(5, None), (3, ""), (4, " \t\n"), (9, "one two"), (9, "one two"), (7, "ONE TWO"), (8, "x " * 50_000), (None, "a b c d e f")]
    got = near_duplicates(documents(rows), shingle=4).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    zero = "0" * 16
    assert by[3, zero] == by[4, zero] == by[5, zero] == 3
    assert [r.component_id for r in got if r.doc_id in (7, 9)] == [7, 7, 7]
    assert near_duplicates(documents([])).collect() == []
