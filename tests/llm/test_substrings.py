import hashlib
import random
import re

import numpy as np
import pandas as pd

from mnesis.llm import queries
from mnesis.llm.substrings import recompress, remove_repeats

SF = "/root/testdata/sf0.01"


def plain(rows, w):
    """rows: (doc_id, text), in order."""
    seen, out = set(), []
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for i in range(len(words) - w + 1):
            key = tuple(words[i : i + w])
            if key in seen:
                gone[i : i + w] = [True] * w
            seen.add(key)
        kept = " ".join(x for x, g in zip(words, gone, strict=True) if not g)
        out.append((doc, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_whole_table_equals_brute_force(spark):
    got = queries.op9_substrings(spark, SF).toPandas().sort_values("doc_id")
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    want = plain(list(zip(docs.doc_id, docs.text, strict=True)), 20)
    assert [tuple(x) for x in got.itertuples(index=False)] == want
    assert sum(x[2] for x in want) > 1000


def test_random_repeats_runs_and_copies(spark, documents):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)] + ["é", "\xa0", "ß"]
    for window in (3, 20):
        rows, stock = [], [[rng.choice(vocab) for _ in range(60)] for _ in range(4)] + [["a"] * 70, ["a", "b"] * 40]
        for i in range(120):
            words = []
            for _ in range(rng.randint(0, 5)):
                p = rng.choice(stock)
                a = rng.randrange(len(p))
                words += p[a : a + rng.randint(1, 50)] if rng.random() < 0.7 else [rng.choice(vocab) for _ in range(rng.randint(1, 30))]
            rows.append((i, rng.choice(["", " ", "\n"]) + "".join(w + rng.choice([" ", "\t\n", "  "]) for w in words)))
        rows[7] = (7, None)
        got = sorted(tuple(r) for r in remove_repeats(documents(rows), window=window, block_bytes=700, bucket_bytes=500).collect())
        assert got == plain(rows, window)


def test_odd_rows(spark, documents):
    text = " ".join(f"x{i}" for i in range(30))
    rows = [(4, text), (4, text), (None, text), (2, None), (3, ""), (1, "only " * 40_000)]
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_words, r.n_removed) for r in remove_repeats(documents(rows)).collect())
    assert got == [(-1, 30, 30), (1, 40_000, 39_999), (2, 0, 0), (3, 0, 0), (4, 30, 0), (4, 30, 30)]
    assert remove_repeats(documents([])).collect() == []


def test_equal_content_has_equal_interior_names():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 60, 200).astype(np.uint64)
    a = np.concatenate([rng.integers(0, 1 << 60, 31).astype(np.uint64), common, rng.integers(0, 1 << 60, 5).astype(np.uint64)])
    b = np.concatenate([rng.integers(0, 1 << 60, 8).astype(np.uint64), common])
    x, y = (recompress(v, np.array([0, len(v)]), 4, 20) for v in (a, b))
    inside = lambda r, at: {(n, p - at, q - at) for n, p, q in zip(*(v.tolist() for v in r), strict=True) if p >= at and q <= at + 200}
    assert inside(x, 31) == inside(y, 8)
    assert len(inside(x, 31)) > 40
