"""Queries that run over whole tables."""

from mnesis.operators import writes
from mnesis.plans import catalogue

SF = "/root/testdata/sf0.01"


def test_bridges_reach_beyond_the_first_ids(spark):
    got = catalogue.QUERIES["graph_bridge"](spark, SF)
    assert got.where("a >= 20").count() > 0 < got.where("b >= 200").count()


def test_all_existing_edges_are_offered_and_the_current_ones_rejected(spark):
    got = catalogue.QUERIES["edge_insert_dedup"](spark, SF)
    from mnesis.sources.frames import Frames

    edges = Frames(spark, SF).edges.where("dst IS NOT NULL")
    current = edges.where("invalid_at IS NULL").select("src", "dst", "etype")
    gone = edges.where("invalid_at IS NOT NULL AND id >= 50").select("src", "dst", "etype").subtract(current)
    assert got.join(current, ["src", "dst", "etype"]).count() == 0
    assert gone.count() == gone.join(got, ["src", "dst", "etype"]).count() > 0


def test_groups_settle_on_paths_of_more_than_fifty_links(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(56)], "a long, b long")
    assert {r.id: r.grp for r in writes.groups(pairs).collect()} == dict.fromkeys(range(57), 0)
