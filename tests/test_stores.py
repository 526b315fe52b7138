"""Attachments, rounds of parameters, ingest and packing over stores and batches."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from mnesis.model import DEFAULT
from mnesis.operators import attachments, autotune, changes, packing
from mnesis.operators.evaluate import mutation_ladder
from mnesis.sources import ingest
from mnesis.sources.commits import Change, Store

at = lambda t: F.lit(t).cast("timestamp_ntz")


def uploads(spark, *rows):
    return spark.createDataFrame([(i, m, c if c is None else c.encode(), "image/png") for i, m, c in rows], "id long, memory_id long, content binary, mime string")


def test_content_goes_with_its_last_reference(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.create("memories", spark.range(4), "id", 2)
    store.create("changelog", spark.createDataFrame([], changes.LOG), None)
    attachments.create(store, 2)
    put = lambda t, *rows: store.commit("upload", attachments.uploaded(uploads(spark, *rows), store.read("attachments"), store.read("blobs"), at(t)))
    put("2024-01-01", (1, 0, "a"), (2, 0, "a"), (3, 1, "a"), (4, 1, "b"), (5, 2, ""), (6, 2, None), (7, 3, "c"))
    names = lambda: sorted(bytes(r.content).decode() for r in store.read("blobs").collect())
    assert names() == ["", "a", "b", "c"] and store.read("attachments").count() == 5
    store.commit("delete", {"attachments": Change("upsert", attachments.deleted(store.read("attachments"), spark.createDataFrame([(4,)], "id long")))})
    assert [r.id for r in attachments.of_memories(store.read("attachments"), spark.range(1, 2)).collect()] == [3]
    assert [r.id for r in attachments.of_memories(store.read("attachments"), spark.range(1, 2), True).collect()] == [3, 4]
    attachments.sweep(store, at("2024-02-01"))
    assert names() == ["", "a", "b", "c"], "deleted rows still refer to their content"
    store.commit("purge", {"memories": Change("delete", spark.createDataFrame([(3,)], "id long")), "attachments": Change("delete", spark.createDataFrame([(1,), (4,)], "id long"))})
    put("2024-01-31 12:00:00", (8, 3, "d"))
    attachments.sweep(store, at("2024-02-01"))
    assert names() == ["", "a", "d"], "what is younger than the grace stays"
    assert sorted(r.memory_id for r in store.read("changelog").collect()) == [3, 3]
    base = store.version()
    orphans, blobs = attachments.garbage(store.read("memories", base), store.read("attachments", base), store.read("blobs", base), at("2024-03-01"))
    assert blobs.count() == 1
    put("2024-03-01", (9, 0, "d"))
    with pytest.raises(Exception, match="was changed by upload"):
        store.commit("sweep", {"attachments": Change("delete", orphans), "blobs": Change("delete", blobs)}, base)
    attachments.sweep(store, at("2024-03-01"))
    assert names() == ["", "a", "d"]


def test_rounds_equal_a_simulation(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    autotune.create(store)
    r, p = random.Random(4), DEFAULT
    state, version, pending, seen = p, 0, None, []
    for number in range(9):
        ladder = mutation_ladder(state)
        tried = [ladder[(version * 4 + i) % len(ladder)] for i in range(4)]
        passing = [] if number in (2, 4) else [(tried[0][0], 0.1), (tried[1][0], 0.2 if number in (3, 7) else 0.1)]
        gate = lambda mutants, now, passing=passing, want=state: (autotune.told(now) == autotune.told(want) or pytest.fail("other parameters")) and spark.createDataFrame([(n, dict(passing).get(n, 0.0), 0.01, n in dict(passing)) for n, _ in mutants], "mutant string, delta double, p_value double, gate_pass boolean")
        got = autotune.play(store, number, gate, p)
        assert autotune.play(store, number, lambda *_: pytest.fail("played again"), p) == got
        best = max(passing, key=lambda x: x[1])[0] if passing else None
        if best is None:
            want, pending = ("rolled_back" if pending else "no_candidate"), None
        elif pending == best:
            want, pending, version, state = "solidified", None, version + 1, dict(tried)[best]
        else:
            want, pending = ("pending_reset" if pending else "first_pass"), best
        seen.append(want)
        assert got == want
        row = store.read("autotune_pending").first()
        assert (row and row.mutation) == pending
        if number == 4:
            assert autotune.told(autotune.current(store)) == autotune.told(state)
    assert set(seen) >= {"first_pass", "solidified", "rolled_back", "pending_reset", "no_candidate"} and store.read("param_snapshots").count() == version + 1
    assert autotune.decide("x", ("x", 1), 3) == ("first_pass_held", 2) and autotune.decide("x", ("x", 2), 3) == ("solidified", 0) and autotune.decide("y", ("x", 2), 3) == ("pending_reset", 1)


def test_what_was_stopped_goes_on(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.create("items", spark.createDataFrame([], "seq long, n long"), None)
    store.create("rejects", spark.createDataFrame([], ingest.REJECT), None)
    rows = spark.range(100).select((F.col("id") * F.when(F.col("id") > 50, 10).otherwise(1)).alias("seq"), F.when(F.col("id") % 17 == 3, "bad").otherwise(F.col("id").cast("string")).alias("text")).unionByName(spark.createDataFrame([(None, "1")], "seq long, text string"))

    def make(part):
        return part.assign(n=part["text"].astype("int64"))

    run = lambda **k: ingest.ingest(store, "items", rows, lambda b: ingest.guarded(b, make, "seq long, n long", 8), "in", 300, **k)
    assert run(most=1) == 1 and store.marks() == {"in": 299}

    def torn(batch):
        return ingest.guarded(batch, make, "seq long, n long", 8).withColumn("n", F.when(F.col("seq") > 600, F.raise_error(F.lit("killed"))).otherwise(F.col("n")))

    with pytest.raises(Exception, match="killed"):
        ingest.ingest(store, "items", rows, torn, "in", 300)
    assert run() > 0 and run() == 0
    ok = [i for i in range(100) if i % 17 != 3]
    assert sorted(r.n for r in store.read("items").collect()) == ok
    bad = store.read("rejects").collect()
    assert sorted(r.seq for r in bad) == [i * (10 if i > 50 else 1) for i in range(100) if i % 17 == 3] and all("bad" in r.error for r in bad)


def test_pairs_lose_the_last_token_of_the_longer(spark):
    for a, b, most in itertools.product(range(8), range(8), range(1, 12)):
        x, y = a, b
        while x + y > most:
            x, y = (x - 1, y) if x > y else (x, y - 1)
        assert packing.cut_pair(a, b, most) == (x, y)


def test_packs_stay_within_the_budget(spark):
    r = random.Random(5)
    for most in (1, 3, 64):
        lengths = [r.randrange(1, 100) for _ in range(200)] + [0, 100]
        got = packing.packs(lengths, 100, most)
        assert sorted(i for p in got for i in p) == list(range(202)) and all(len(p) <= most and len(p) * max(lengths[i] for i in p) <= 100 for p in got)
    rows = [(i, "x y", None if i == 3 else " ".join(r.choice("xyz") for _ in range(r.randrange(300)))) for i in range(300)]
    pairs = spark.createDataFrame(rows, "id long, query string, text string")
    score = lambda pack: [len(set(q) & set(t)) / 2 for q, t in pack]
    run = lambda budget, n: {x.id: (x.tokens, x.relevance, x.padded) for x in packing.score_packed(pairs.repartition(n), str.split, score, budget, 50, 2).collect()}
    a, b = run(50, 1), run(500, 7)
    assert {k: v[:2] for k, v in a.items()} == {k: v[:2] for k, v in b.items()} and max(v[2] for v in a.values()) <= 50 and max(v[2] for v in b.values()) <= 500 and a[3] == (4, 0.0, a[3][2])
    with pytest.raises(ValueError, match="budget"):
        packing.score_packed(pairs, str.split, score, 49, 50)
    assert packing.score_packed(pairs.limit(0), str.split, score).count() == 0


def test_quantiles_by_index(spark):
    from mnesis.operators import reads

    r = random.Random(6)
    rows = [("a", float(r.choice([1, 1, 1, r.random() * 9]))) for _ in range(5000)] + [("b", None), ("b", None), ("b", 3.0)] + [("c", 7.0)] * 400 + [("d", None)] + [("e", float(i)) for i in range(997)]
    got = {x.kind: tuple(x)[1:] for x in reads.latency(spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "kind string, value double, id long").repartition(5), 1, 50, 95, 100).collect()}
    for kind in "abcde":
        v = sorted((x for k, x in rows if k == kind), key=lambda x: (x is not None, x or 0))
        assert got[kind] == tuple(v[max(1, len(v) * s // 100) - 1] for s in (1, 50, 95, 100))


@pytest.mark.parametrize(("asked", "block"), [(3, 7), (512, 8192)])
def test_rankings_in_blocks_equal_all_pairs(spark, asked, block):
    import numpy as np

    from mnesis.operators import evaluate

    g = np.random.default_rng(7)
    x = g.integers(-2, 3, (60, 4)).astype(float)
    rows = [(i % 2, i, x[i].tolist()) for i in range(60)] + [(1, 60, None), (None, 61, [0.0] * 4)]
    q = [(p, i, x[i].tolist()) for p in (0, 1) for i in range(0, 60, 5)] + [(9, 3, x[3].tolist()), (0, 4, None)]
    schema = "pool long, {} long, embedding array<double>"
    got = evaluate.ranked(spark.createDataFrame(q, schema.format("qid")), spark.createDataFrame(rows, schema.format("id")), 6, asked, block).collect()
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    want = []
    for p, i, e in q:
        if e and p < 9:
            each = sorted((-np.floor(unit[i] @ unit[j] * 1e6 + 0.5) / 1e6, j) for j in range(60) if j != i and j % 2 == p)[:6]
            want += [(p, i, j, n + 1, -c) for n, (c, j) in enumerate(each)]
    assert sorted((r.pool, r.qid, r.id, r["rank"], r.cos) for r in got) == sorted(want)


def test_groups_of_chains_hubs_and_rings(spark):
    from mnesis.operators import writes

    r = random.Random(8)
    names = list(range(400))
    r.shuffle(names)
    pairs = [(names[i], names[i + 1]) for i in range(120)] + [(names[200], names[i]) for i in range(201, 300)] + [(names[300 + i], names[300 + (i + 1) % 20]) for i in range(20)] + [(names[350], names[350]), (names[5], names[60]), (names[60], names[5])]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = writes.groups(spark.createDataFrame(pairs, "a long, b long"))
    assert sorted(map(tuple, got.select("id", "grp").collect())) == sorted((x, find(x)) for x in root)
    assert writes.groups(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ids_keys_and_files(spark, tmp_path):
    import hashlib
    import re
    import uuid

    from mnesis.functions import columns as C
    from mnesis.sources import sinks

    rows = spark.range(200).select(C.uuid7(F.lit("2024-01-02 03:04:05.678").cast("timestamp")).alias("u"), C.uuid7().alias("v")).collect()
    ids = [uuid.UUID(x.u) for x in rows]
    assert len(set(ids)) == 200 and all(i.version == 7 and i.variant == uuid.RFC_4122 and i.int >> 80 == 1704164645678 for i in ids) and all(uuid.UUID(x.v).version == 7 for x in rows)
    texts = ["  A\t b　C ", None, "", "x\x1fy\n", "ÄÖ  ü"]
    got = [x.k for x in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(C.query_key(F.col("t")).alias("k")).collect()]
    assert got == [hashlib.sha256(re.sub(r"\s+", " ", (t or "").strip()).lower().encode()).hexdigest() for t in texts]
    assert spark.range(1).select(C.vector_text(F.array(F.lit(0.5), F.lit(-1.0), F.lit(1e-9))).alias("t")).first().t == "[0.5000000,-1.0000000,0.0000000]"
    df = spark.sql("SELECT 1 AS id, 'a, \"b\"' AS reason, TIMESTAMP_NTZ '2024-01-02 03:04:05' AS at, array(1, 2) AS ids, CAST(NULL AS STRING) AS note")
    sinks.change_list(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert (back.id, back.reason, back["at"], back.ids, back.note) == ("1", 'a, "b"', "2024-01-02T03:04:05", "[1,2]", None)
    sinks.proposals(df, str(tmp_path / "json"))
    assert [x.value for x in spark.read.text(str(tmp_path / "json")).collect()] == ['{"id":1,"reason":"a, \\"b\\"","at":"2024-01-02T03:04:05","ids":[1,2]}']
    with pytest.raises(Exception, match="exist"):
        sinks.proposals(df, str(tmp_path / "json"))
