import hashlib
import itertools
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from mnesis.llm import queries
from mnesis.llm.manifest import Forest, digest_of, manifest

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BAD = lambda: F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
hx = lambda *p: hashlib.sha256("".join(p).encode()).hexdigest()
part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """All levels of the tree over the nodes, the last of one."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([hx(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def climb(levels, i, own):
    proof = ""
    for nodes in levels[:-1]:
        run, j = nodes[i // 16 * 16 : i // 16 * 16 + 16], i % 16
        proof, own, i = proof + "".join(run[:j] + run[j + 1 :]), hx(*run[:j], own, *run[j + 1 :]), i // 16
    return proof, own


def brute(rows):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    by = {}
    for i, t, lang, source, n in rows:
        leaf = lambda x: hx(*map(part, (i, source, lang, n, x)))  # noqa: B023, E731
        bad = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        by.setdefault(source, []).append(((i is not None, i or 0), leaf(t), i, leaf(t.translate(lower)) if bad and t is not None else leaf(t)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[1] for x in sorted(by[s])]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, leaf, doc_id, other) in enumerate(sorted(by[s])):
            proof, sub = climb(trees[s], i, other)
            more, root = climb(top, k, sub)
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], hx(proof + more), root, root == top[-1][0]))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()), key=repr)


def test_whole_table_equals_sql_and_brute_force(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = duckdb.sql(queries.oracle_sql()["op13_merkle"])
    want = sorted(map(tuple, want.select("doc_id, leaf, subroot, root, proof_sha256, folded_root, verified").fetchall()), key=repr)
    rows = got(queries.op13_merkle(spark, SF))
    assert rows == want == brute(duckdb.sql("SELECT doc_id, text, lang, source, n_chars FROM documents").fetchall())
    assert 100 < sum(not r[-1] for r in rows) < 300


@pytest.mark.parametrize(("n", "sources", "chunk", "fan"), [(1, 1, 4, 2), (17, 1, 4, 2), (700, 1, 7, 3), (700, 40, 16, 2), (300, 300, 5, 16), (900, 3, 2048, 16)])
def test_shapes(spark, n, sources, chunk, fan):
    """Trees of one leaf, one source or many sources of one; chunks that cut runs anywhere and several rounds of merging."""
    r = random.Random(n + sources)
    rows = [(i, f"Text {i}", "en", f"s{r.randrange(sources)}" if r.random() < 0.6 else "s0", i) for i in range(n)]
    assert got(manifest(spark.createDataFrame(rows, DOCS).repartition(5), BAD(), chunk, fan)) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "", "", "", 0), (5, "A", "en", None, 1), (5, "A", "en", None, 1), (5, "B", "en", None, 1), (-7, "É X" * 50_000, "fr", "é", -3), (0, "Q", None, "z", None), (12, "-", "-", "Z", 1), (19, "1:x", "en", "Z", 3)] + [(k, "TEXT", "en", "many", 4) for k in range(40)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("tree", "leaf", "position", "chunk", "k", "idx")})
    assert got(manifest(docs, BAD(), 8, 2)) == brute(rows)
    assert {r[-1] for r in got(manifest(docs, None, 8, 2))} == {True}
    assert manifest(spark.createDataFrame([], DOCS), BAD()).collect() == []


def test_merging_is_associative():
    """Fragments give the same root in whatever order and grouping their nodes come together."""
    leaves = {0: [hx(str(i)) for i in range(300)], 1: [hx("one")], 2: [hx(f"b{i}") for i in range(37)]}
    want = tree([tree(x)[-1][0] for x in leaves.values()])[-1][0]
    nodes = [(t, 0, i, d) for t, x in leaves.items() for i, d in enumerate(x)]

    def merged(parts):
        forest = Forest(3)
        forest.leaves.update({t: len(x) for t, x in leaves.items()})
        for t, level, i, d in parts:
            forest.add(t, level, i, (d, 0, 1))
        return [(*k, v[0]) for k, v in forest.nodes.items()]

    for seed in range(5):
        r = random.Random(seed)
        mixed = r.sample(nodes, len(nodes))
        cuts = sorted(r.sample(range(len(mixed)), 6))
        parts = [merged(mixed[a:b]) for a, b in itertools.pairwise([0, *cuts, len(mixed)])]
        while len(parts) > 1:
            k = r.randrange(len(parts) - 1)
            parts[k : k + 2] = [merged(parts[k] + parts[k + 1])]
        assert [x[3] for x in parts[0]] == [want]
    assert digest_of(["a", "b"]) == hx("ab")
