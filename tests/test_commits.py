import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mnesis.operators import changes, lifecycle
from mnesis.plans import catalogue
from mnesis.sources import commits
from mnesis.sources.commits import Change, Conflict, Damaged, Store

MEM = "id long, bank string, body string, title string, source_tier string, ttl_state string, content_hash string, invalid_at timestamp_ntz, superseded_by long, valid_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz, adopt_count long, embedding array<float>"


def memories(spark, n=40):
    return spark.range(n).selectExpr(
        "id", "'hermes' AS bank", "concat('text ', id) AS body", "concat('t', id) AS title", "'agent' AS source_tier", "IF(id % 5 = 0, 'retired', 'trial') AS ttl_state", "'h' AS content_hash", "CAST(NULL AS TIMESTAMP_NTZ) AS invalid_at", "CAST(NULL AS LONG) AS superseded_by",
        *[f"TIMESTAMP_NTZ '2024-01-01' AS {c}" for c in ("valid_at", "created_at", "updated_at")], "id AS adopt_count", "array(CAST(id AS FLOAT)) AS embedding",
    )


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    s.create("memories", memories(spark), "id", buckets=4)
    s.create("changelog", spark.createDataFrame([], changes.LOG), None)
    return s


AT = lambda: F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
ids = lambda df: sorted(r.id for r in df.select("id").collect())


def delete(spark, *gone):
    def make(m):
        rows, log = changes.deleted(m, spark.createDataFrame([(i,) for i in gone], "id long"), AT())
        return {"memories": Change("upsert", rows), "changelog": Change("append", log)}

    return make


def test_versions_and_upserts(spark, store):
    v = changes.apply(store, "delete", delete(spark, 1, 2, 5, 999))
    assert v == store.version() == 2 and store.entry()["op"] == "delete"
    now, before = store.read("memories"), store.read("memories", 1)
    assert ids(now) == list(range(40)) and ids(now.where("ttl_state = 'retired'")) == sorted({1, 2, *range(0, 40, 5)}) and ids(before.where("ttl_state = 'retired'")) == list(range(0, 40, 5))
    assert now.where("id = 1").first().embedding is None
    log = sorted((r.op, r.memory_id, r.detail) for r in store.read("changelog").collect())
    assert log == [("delete", i, '{"purge":false,"state":"retired"}') for i in (1, 2)]
    old, new = (store.entry(k)["tables"]["memories"]["dirs"] for k in (1, 2))
    assert any(old[b] == new[b] for b in old), "untouched buckets aren't written again"


def test_a_failed_write_leaves_nothing(spark, store):
    rows, log = changes.deleted(store.read("memories"), spark.range(3).select("id"), AT())
    broken = log.withColumn("detail", F.raise_error(F.lit("disk full")).cast("string"))
    with pytest.raises(Exception, match="disk full"):
        store.commit("delete", {"memories": Change("upsert", rows), "changelog": Change("append", broken)})
    assert store.version() == 1 and store.read("memories").where("ttl_state = 'retired'").count() == 8 and store.read("changelog").count() == 0
    changes.apply(store, "delete", delete(spark, 3))
    assert store.read("changelog").count() == 1
    assert store.vacuum(1) > 0 and store.versions() == [2] and store.read("memories").count() == 40


def test_of_two_writers_one_loses(spark, store):
    base = store.version()
    first, second = delete(spark, 1)(store.read("memories", base)), delete(spark, 2)(store.read("memories", base))
    assert store.commit("delete", first, base) == 2
    with pytest.raises(Conflict, match="memories was changed by delete in version 2"):
        store.commit("delete", second, base)
    assert store.version() == 2 and [r.memory_id for r in store.read("changelog").collect()] == [1]
    changes.apply(store, "delete", delete(spark, 2))
    assert sorted(r.memory_id for r in store.read("changelog").collect()) == [1, 2]


def test_appends_go_together(spark, store):
    base = store.version()
    row = lambda i: {"changelog": Change("append", spark.createDataFrame([("note", i, "{}", None)], changes.LOG))}
    assert [store.commit("note", row(i), base) for i in range(3)] == [2, 3, 4]
    assert sorted(r.memory_id for r in store.read("changelog").collect()) == [0, 1, 2] and store.read("changelog", 3).count() == 2
    with pytest.raises(ValueError, match="no key"):
        store.commit("x", {"changelog": Change("upsert", store.read("changelog"))})
    with pytest.raises(ValueError, match="is there"):
        store.create("changelog", store.read("changelog"), None)


def test_write_paths(spark, store):
    m = store.read("memories")
    rows, log = changes.superseded(m, spark.createDataFrame([(1, 101, "new body"), (77, 177, "x")], "id long, new_id long, body string"), AT())
    assert sorted((r.id, r.superseded_by, r.body) for r in rows.collect()) == [(1, 101, "text 1"), (101, None, "new body")]
    got = {(r.op, r.memory_id): json.loads(r.detail) for r in log.collect()}
    assert got[("supersede", 1)] == {"new_id": "101", "valid_at": "2024-02-01 00:00:00"} and got[("retain", 101)]["title"] == "t1" and len(got) == 2
    rows, log = changes.patched(m, spark.createDataFrame([(2, "u", None), (3, None, "b"), (88, "x", "y")], "id long, title string, body string"), AT())
    assert sorted((r.memory_id, r.detail) for r in log.collect()) == [(2, '{"patched":["title"]}'), (3, '{"patched":["body"]}')] and ids(rows) == [2, 3]
    rows, events, log = changes.adopted(m, spark.createDataFrame([(1, 4, "c" * 200), (2, 4, None), (3, 99, "c")], "id long, memory_id long, caller string"), AT())
    assert [(r.id, r.adopt_count) for r in rows.collect()] == [(4, 6)] and events.count() == 2
    assert sorted(json.loads(r.detail)["caller"] for r in log.collect()) == ["c" * 120, "main"]
    linked = m.withColumn("superseded_by", F.when(F.col("id") == 9, 7).cast("long"))
    gone, pointers, log = changes.purged(linked, spark.createDataFrame([(7,), (70,), (7,)], "id long"), AT())
    assert ids(gone) == [7] and [(r.id, r.superseded_by) for r in pointers.collect()] == [(9, None)] and log.first().detail == '{"purge":true,"state":"deleted"}'
    v = store.commit("purge", {"memories": Change("delete", gone)})
    assert ids(store.read("memories", v)) == [i for i in range(40) if i != 7]


def test_life_cycle_moves_are_logged(spark, store):
    aged = memories(spark).selectExpr("* EXCEPT (ttl_state, created_at)", "'candidate' AS ttl_state", "TIMESTAMP_NTZ '2023-01-01' AS created_at", "'episodic' AS memory_type")
    log = changes.moved(lifecycle.scan(aged, spark.createDataFrame([], "memory_id long, ts timestamp_ntz, kind string"), AT()), AT())
    first = sorted((r.memory_id, r.detail) for r in log.collect())[:3]
    assert first == sorted([(0, '{"from":"candidate","to":"trial","reason":"promote_candidates"}'), (0, '{"from":"decaying","to":"archived","reason":"archive_decaying"}'), (0, '{"from":"trial","to":"decaying","reason":"decay_trials"}')])


def test_copies_are_verified(spark, store, tmp_path):
    changes.apply(store, "delete", delete(spark, 1))
    copy = f"file://{tmp_path}/copy"
    store.snapshot(copy)
    other = Store(spark, f"file://{tmp_path}/other")
    got = other.restore(copy)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, store.counts().collect())) and other.read("memories").exceptAll(store.read("memories")).isEmpty()
    changes.apply(other, "delete", delete(spark, 2))
    with pytest.raises(ValueError, match="isn't empty"):
        other.restore(copy)
    part = next(Path(tmp_path, "copy/tables/memories").glob("part-*"))
    part.unlink()
    with pytest.raises(Damaged, match="differ"):
        Store(spark, f"file://{tmp_path}/third").restore(copy)
    Path(tmp_path, "copy/counts/_SUCCESS").unlink()
    with pytest.raises(Damaged, match="never finished"):
        Store(spark, f"file://{tmp_path}/fourth").restore(copy)


def wide_scans(df):
    """Whether a plan reads the wide column `body`."""
    return "body" in df._jdf.queryExecution().executedPlan().toString()


def test_updates_are_layers(spark, store, tmp_path):
    """A write of two columns neither rewrites nor reads the others, and every reader sees it: versions, copies, upserts, a vacuum and later rows with keys that weren't there."""
    state = lambda rows: spark.createDataFrame(rows, "id long, ttl_state string")
    old = store.entry()["tables"]["memories"]["dirs"]
    v = store.commit("a", {"memories": Change("update", state([(1, "active"), (2, None), (2, None), (99, "active"), (None, "x")]))})
    assert store.entry()["tables"]["memories"]["dirs"] == old and not wide_scans(store.read("memories").select("id", "ttl_state"))
    got = lambda *a: {r.id: (r.ttl_state, r.adopt_count, r.body) for r in store.read("memories", *a).collect()}
    assert store.read("memories").count() == 40 and got()[1] == ("active", 1, "text 1") and got()[2] == (None, 2, "text 2") and got(1)[2] == ("trial", 2, "text 2")
    store.commit("b", {"memories": Change("update", spark.createDataFrame([(1, 50)], "id long, adopt_count int"))})
    assert got()[1] == ("active", 50, "text 1") and got(v)[1] == ("active", 1, "text 1")
    store.commit("c", {"memories": Change("append", memories(spark, 100).where("id = 99"))})
    assert got()[99][0] == "trial", "the update came before the row"
    base = store.version()
    store.commit("d", {"memories": Change("append", memories(spark, 102).where("id = 101"))})
    with pytest.raises(Conflict):
        store.commit("e", {"memories": Change("update", state([(1, "x")]))}, base)
    before = got()
    store.snapshot(f"file://{tmp_path}/copy")
    other = Store(spark, f"file://{tmp_path}/other")
    assert sorted(map(tuple, other.restore(f"file://{tmp_path}/copy").collect())) == sorted(map(tuple, store.counts().collect()))
    assert other.read("memories").exceptAll(store.read("memories")).isEmpty()
    store.vacuum(1)
    assert got() == before
    changes.apply(store, "delete", delete(spark, 1, 2))  # an upsert of whole rows
    assert got()[1] == ("retired", 50, "text 1") and {k: x for k, x in got().items() if k not in (1, 2)} == {k: x for k, x in before.items() if k not in (1, 2)}
    store.commit("f", {"memories": Change("delete", state([(1, "")]).select("id"))})
    store.commit("g", {"memories": Change("append", memories(spark, 2).where("id = 1"))})
    assert got()[1] == ("trial", 1, "text 1"), "what was updated before it went"
    with pytest.raises(ValueError, match="no key"):
        store.commit("x", {"changelog": Change("update", store.read("changelog"))})


def test_layers_are_folded(spark, store, monkeypatch):
    monkeypatch.setattr(commits, "LAYERS", 2)
    for k in range(5):
        store.commit("u", {"memories": Change("update", spark.createDataFrame([(3, f"s{k}"), (4 + k, "x")], "id long, ttl_state string"))})
        assert len(store.entry()["tables"]["memories"]["layers"]) == (1, 2, 0, 1, 2)[k]
    got = {r.id: r.ttl_state for r in store.read("memories").collect()}
    assert len(got) == 40 and got[3] == "s4" and [got[4 + k] for k in range(6)] == ["x"] * 5 + ["trial"]


def test_a_change_of_state_leaves_the_texts(spark, tmp_path, monkeypatch):
    """commit_replay writes the memories' texts once, whatever it deletes and adopts."""
    monkeypatch.setattr(catalogue, "fresh_path", lambda s, name: f"file://{tmp_path}/{name}")
    got = catalogue.QUERIES["commit_replay"](spark, "/root/testdata/sf0.001").first()
    assert got.deletions > 0 and got.adoptions > 0
    size = lambda v: sum(p.stat().st_size for d in v for p in Path(tmp_path, "store", d).glob("*.parquet"))
    spec = Store(spark, f"file://{tmp_path}/store").entry()["tables"]["memories"]
    texts = {d for x in spec["dirs"].values() for d in x}
    written = {str(p.relative_to(tmp_path / "store")) for p in Path(tmp_path, "store/data/memories").glob("*/bucket=*")}
    assert len({d.split("/")[2] for d in texts}) == 1 and 0 < size(written - texts) < size(texts)
    assert all("body" not in json.dumps(x["schema"]) for x in spec["layers"]) and len(spec["layers"]) == 2
