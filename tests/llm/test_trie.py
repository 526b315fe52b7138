import hashlib
import random
import re
import zlib

import duckdb
from pyspark.sql import functions as F

from mnesis.llm import queries, trie
from mnesis.llm.common import Scratch
from mnesis.llm.ordering import numbered, running_sums
from mnesis.llm.trie import conversation_trie, grafted_trie

SF = "/root/testdata/sf0.01"
TURNS = "conv_id long, turn long, role string, text string"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
order = lambda rows: sorted(rows, key=repr)
got = lambda df: order(tuple(r[c] for c in NAMES) for r in df.collect())


def conversations(rows):
    key = lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest())
    out = {}
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


def rebuilt(own):
    h = lambda c: zlib.crc32(str(c).encode()) % 4
    return {c: own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[: h(c)] + t[h(c) :] for c, t in own.items()}


def brute(convs):
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * words
    return order((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in members.items())


def test_whole_table_equals_sql_and_brute_force(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = duckdb.sql(queries.oracle_sql()["op12_prefix_trie"])
    rows = got(queries.op12_prefix_trie(spark, SF))
    assert rows == order(map(tuple, want.select(", ".join(NAMES)).fetchall()))
    assert rows == brute(rebuilt(conversations(duckdb.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall())))


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 2, "a", "x y"), (1, None, "", "z"), (1, 2, "a", "x y"), (None, 1, "a", "lost"), (-5, 1, "u", "b"), (-5, 7, "u", "Ü\x0bv w" * 30_000), (40, 1, None, "q"), (41, 3, "u", "q"), (43, 1, "u", "q"), (60, 2, "u", " \t"), (61, 1, "r", "t")]
    frame = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("x") for c in ("s", "words", "k", "position", "i", "rank")})
    assert got(grafted_trie(frame)) == brute(rebuilt(conversations(rows)))
    assert got(conversation_trie(frame)) == brute(conversations(rows))
    assert grafted_trie(spark.createDataFrame([], TURNS)).collect() == []


def test_long_and_common_conversations(spark, monkeypatch):
    """Blocks of three turns: conversations of up to 60 need several rounds; many are alike, prefixes of others, or part late."""
    monkeypatch.setattr(trie, "BLOCK", 3)
    r, rows = random.Random(5), []
    base = [(r.choice("ab"), f"t{r.randrange(4)} w") for _ in range(60)]
    for c in range(260):
        n = 60 if c == 7 else r.randrange(1, 40)
        turns = base[:n] if r.random() < 0.5 else base[: r.randrange(n)] + [("c", f"t{r.randrange(2)}") for _ in range(r.randrange(1, 9))]
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    rows += [(c, 0, "same", "first words here") for c in range(300, 500)]
    frame = spark.createDataFrame(rows, TURNS)
    assert got(conversation_trie(frame)) == brute(conversations(rows))
    assert got(grafted_trie(frame)) == brute(rebuilt(conversations(rows)))
    scratch = Scratch(spark, "test")
    own = trie.own_turns(frame, scratch)
    once = got(trie.prefix_trie(trie.with_roots(own.withColumnRenamed("k", "i"), own.select("conv_id").distinct()), scratch, piece=7))
    assert once == brute(conversations(rows))


def test_positions_and_running_sums(spark):
    scratch = Scratch(spark, "test")
    r = random.Random(3)
    rows = [(r.randrange(50), r.randrange(9)) for _ in range(700)]
    out = running_sums(numbered(spark.createDataFrame(rows, "a long, b long").repartition(6), ["a", "b"], scratch, "n"), "position", ["b"], scratch, "s", block=7).orderBy("position").collect()
    want, total = [], 0
    for k, (a, b) in enumerate(sorted(rows)):
        total += b
        want.append((a, b, k, total))
    assert [tuple(x) for x in out] == want
