import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mnesis.model import DEFAULT
from mnesis.operators import accesslog, averages, changes, insight, lifecycle
from mnesis.sources.commits import Change, Store

NOW = datetime(2024, 1, 31, 12)
at = lambda t: F.lit(str(t)).cast("timestamp_ntz")
LOG = "id long, memory_id long, ts timestamp_ntz, kind string, caller string, query string"


def events(spark, n=600):
    r = random.Random(1)
    rows = [(i, r.choice([None, 1, 1, 1, *range(2, 30)]), r.choice(["recall_hit", "adopted", "injected", None]), r.uniform(0, 45)) for i in range(n)]
    rows += [(n, 7, "adopted", 30.0), (n + 1, 7, "adopted", 29.99999), (n + 2, 8, "recall_hit", None)]
    df = spark.createDataFrame(rows, "id long, memory_id long, kind string, ago double")
    return df.select("id", "memory_id", (at(NOW) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("ago") * 86400).cast("decimal(18,6)"))).alias("ts"), "kind", F.lit("c").alias("caller"), F.lit(None).cast("string").alias("query"))


same = lambda df: sorted(map(tuple, df.select("memory_id", "last_signal", "last_adopt", "last_any", "hits", "adopts").collect()), key=str)


def test_state_equals_the_log_after_any_split(spark, tmp_path):
    log = events(spark).cache()
    want = same(lifecycle.access_stats(log, at(NOW)))
    for split in (1, 3):
        store = Store(spark, f"file://{tmp_path}/s{split}")
        accesslog.create(store, 8)
        for n in range(split):
            batch = log.where(F.pmod(F.xxhash64("id"), F.lit(split)) == n)
            v = accesslog.absorb(store, batch, "s", n)
            assert accesslog.absorb(store, batch, "s", n) == v == store.version(), "a repeated batch counts once"
            if n == 1:
                accesslog.compact(store, NOW)
        assert same(accesslog.stats(store, NOW)) == want
        before = store.version()
        accesslog.compact(store, NOW)
        assert same(accesslog.stats(store, NOW)) == want == same(accesslog.stats(store, NOW, version=before))
        assert store.read("access_state").count() < store.read("access_state", before).count() or split == 1
        with pytest.raises(Exception, match="merged by a compaction"):
            accesslog.stats(store, datetime(2024, 1, 20)).collect()
        n = {r.memory_id: r.access_count for r in accesslog.counters(store).collect()}
        assert n[1] == log.where("memory_id = 1 AND kind = 'recall_hit'").count()


def test_a_mark_outlives_conflicts_and_copies(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/a")
    accesslog.create(store, 4)
    base, log = store.version(), events(spark, 20)
    rows = {"access_state": Change("append", accesslog.partial(log).select(*[c.split()[0] for c in accesslog.STATE.split(", ")]))}
    assert store.commit("access", rows, base, ("s", 0)) == base + 1
    assert store.commit("access", rows, base, ("s", 0)) == base + 1, "from an old version: the other's is found when the log's file is there"
    assert store.commit("access", rows, base, ("t", 0)) == base + 2 and store.marks() == {"s": 0, "t": 0}
    store.snapshot(f"file://{tmp_path}/copy")
    other = Store(spark, f"file://{tmp_path}/b")
    other.restore(f"file://{tmp_path}/copy")
    assert other.marks() == {"s": 0, "t": 0}


def feedback(spark, n, hot):
    r = random.Random(2)
    rows = [(i, 5 if r.random() < hot else r.randrange(12), r.choice(["adopted", "adopted", "corrected", "useless", "other"])) for i in range(n)]
    return spark.createDataFrame(rows, "seq long, memory_id long, outcome string")


@pytest.mark.parametrize(("n", "hot"), [(0, 0.5), (3, 0.5), (4000, 0.5), (4000, 0.97)])
def test_averages_equal_the_fold(spark, n, hot):
    f = feedback(spark, n, hot)
    m = spark.createDataFrame([(i, None if i == 3 else (i - 5.5) / 6) for i in range(11)], "id long, polarity double")
    for known in (None, m):
        want = sorted(map(tuple, insight.ema(f, known).collect()))
        assert sorted(map(tuple, averages.ema(f, known).collect())) == want
    steps = averages.steps(f, m).orderBy("memory_id", "seq").collect()
    assert all(b.before == a.after for a, b in zip(steps, steps[1:], strict=False) if a.memory_id == b.memory_id)


def test_runs_are_functions(spark):
    r = random.Random(3)
    for n in (0, 1, 64, 65, 300):
        run, targets = averages.Run(0.1), [r.choice([1.0, -1.0]) for _ in range(n)]
        run.add(targets)
        for x in (-1.0, -0.123456, 0.0, 0.999999, 1.0, *[round(r.uniform(-1, 1), 6) for _ in range(200)]):
            want = x
            for t in targets:
                want = averages.step(want, t, 0.1)
            assert averages.through(run.text(), x, 0.1) == want
    assert n == 300 and len(run.at) < 30


def test_the_timer_reads_state_alone(spark, tmp_path):
    from mnesis.sources.frames import Frames
    from mnesis.streaming import access as stream

    f, t = Frames(spark, "/root/testdata/sf0.001"), datetime(2024, 1, 31)
    store = Store(spark, f"file://{tmp_path}/s")
    store.create("memories", f.memories.select("id", "bank", "memory_type", "ttl_state", "created_at", "updated_at"), "id", 4)
    store.create("changelog", spark.createDataFrame([], changes.LOG), None)
    accesslog.create(store, 4)
    f.access.repartition(2).write.parquet(str(tmp_path / "log"))
    source = spark.readStream.schema(f.access.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    q = stream.life_cycle_of_store(source, store, lambda: t).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert store.marks() == {"access": 1}
    want = lifecycle.access_stats(f.access, at(t))
    assert same(accesslog.stats(store, t)) == same(want)
    moved = store.read("memories").join(f.memories.select("id", F.col("ttl_state").alias("old")), "id").where("old <> ttl_state").count()
    assert moved > 0 and store.read("changelog").select("memory_id").distinct().count() >= moved
    assert lifecycle.scan(store.read("memories"), accesslog.stats(store, t), at(t)).where("new_state <> ttl_state").count() <= moved


def test_averages_of_a_stream_start_where_the_memory_is(spark, tmp_path):
    from mnesis.streaming import access as stream

    f = feedback(spark, 60, 0.3).where("memory_id < 4 AND outcome <> 'other'")
    m = spark.createDataFrame([(0, 0.5), (1, None), (2, -0.25), (3, 1.0)], "id long, polarity double")
    f.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = stream.ema_updates(spark.readStream.schema(f.schema).parquet(str(tmp_path / "in")), m).writeStream.format("memory").queryName("started").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("started").collect())) == sorted(map(tuple, insight.ema(f, m).collect()))


def test_many_memories_of_few_events_go_through_as_batches(spark):
    """Other columns go along, and a memory costs its steps: before, each was a table of its own, and 60,000 took a minute and more."""
    import time

    rows = spark.range(0, 120_000, 1, 2).select(F.floor(F.col("id") / 2).alias("memory_id"), F.col("id").alias("seq"), F.lit("adopted").alias("outcome"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("caller"))
    known = spark.range(59_990).select("id", F.when(F.col("id") % 2 == 0, F.lit(0.5)).alias("polarity"))
    began = time.time()
    got = averages.steps(rows, known, keep=("caller",)).toArrow()
    assert time.time() - began < 25
    want = {(i, s): (b, averages.step(b or 0.0, 1.0, 0.1)) for i in range(59_990) for s, b in ((2 * i, None if i % 2 else 0.5),)}
    want |= {(i, 2 * i + 1): (after, averages.step(after, 1.0, 0.1)) for (i, s), (_, after) in list(want.items())}
    assert {(r["memory_id"], r["seq"]): (r["before"], r["after"]) for r in got.to_pylist()} == want
    assert all(r["caller"] == f"c{r['seq']}" for r in got.to_pylist())
