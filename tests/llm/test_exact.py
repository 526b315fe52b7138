import collections
import hashlib
import re

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnesis.llm import queries
from mnesis.llm.exact import distinct_texts, exact_duplicates

SF = "/root/testdata/sf0.01"
rows_of = lambda df: sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "digest")) for r in df.collect()), key=repr)


def brute(pairs):
    groups = collections.defaultdict(list)
    for i, t in pairs:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        d, first = hashlib.sha256(t.encode()).hexdigest(), True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and first, d))
            first = first and i != keep
    return sorted(out, key=repr)


def test_whole_table_equals_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = duckdb.sql(queries.oracle_sql()["op11_exact_dedup"])
    names = want.columns
    got = queries.op11_exact_dedup(spark, SF)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
    assert dict(got.dtypes)["group_size"] == "bigint" and got.where("kept").count() == len({r[names.index("text_sha256")] for r in want.fetchall()})


def test_odd_rows(spark, documents):
    long = "wörd \t\n" * 50_000
    pairs = [(5, None), (3, ""), (9, " "), (2, "\n\t "), (7, "a  b"), (7, "a b"), (7, "a\x0bb"), (6, "a b "), (None, "a b "), (None, "only"), (None, "only"), (11, "A b"), (12, "a b"), (13, "a b\x00"), (14, long), (15, long.replace("\t", " ")), (-4, long), (-4, long), (20, "a\x1fb")]
    docs = documents(pairs).withColumns({"digest": F.lit(1), "salt": F.lit("x"), "body": F.lit(None), "n": F.lit(2), "keep_id": F.lit(0)})
    assert rows_of(exact_duplicates(docs)) == brute(pairs)
    assert exact_duplicates(documents([])).collect() == []


def test_texts_of_one_digest_stay_apart(spark, documents):
    pairs = [(i, f"text {i % 7}" + "  x" * (i % 3)) for i in range(200)] + [(i, "one") for i in range(200, 300)]
    weak = lambda text: F.substring(F.sha2(text.cast("binary"), 256), 1, 1)
    want = [(r[0], r[1], r[2], r[3], r[4][0]) for r in brute(pairs)]
    assert rows_of(exact_duplicates(documents(pairs), weak)) == sorted(want, key=repr)
    assert distinct_texts(documents(pairs), weak).count() == 22


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(pairs=st.lists(st.tuples(st.one_of(st.none(), st.integers(-9, 9)), st.one_of(st.none(), st.text(" \t\nab", max_size=4))), max_size=40))
def test_any_rows(spark, documents, pairs):
    assert rows_of(exact_duplicates(documents(pairs))) == brute(pairs)


def test_a_hot_group_meets_in_no_task(spark, documents):
    """Half of all rows are one text: after the first exchange it is a row for each salt, and what goes back is dealt by salt."""
    docs = documents([(i, "same" if i % 2 else f"t{i}") for i in range(4000)]).repartition(16)
    groups = distinct_texts(docs)
    hot = groups.where("body = 'same'").first()
    assert hot.group_size == 2000 and bin(hot["mask"] & ((1 << 64) - 1)).count("1") == 64
    assert exact_duplicates(docs).where("keep_id = 1").count() == 2000


def test_native(spark):
    plan = queries.op11_exact_dedup(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
