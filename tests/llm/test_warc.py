import gzip
import hashlib
import zlib
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from mnesis.llm import queries
from mnesis.llm.warc import members, parse, read_archives, record, round_trip, write_archives

SF = "/root/testdata/sf0.01"
PAGES = "page_id long, url string, html string"


def test_whole_table_equals_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = duckdb.sql(queries.oracle_sql()["op4_warc"]).df()
    got = queries.op4_warc(spark, SF).toPandas()
    key = lambda d: sorted(d.astype(object).where(d.notna(), None)[sorted(d.columns)].itertuples(index=False, name=None))
    assert key(got) == key(want)


def test_archives_are_plain_gzip_and_hold_all_pages(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    write_archives(pages, f"file://{tmp_path}/a")
    files = list(Path(tmp_path, "a").glob("*.warc.gz"))
    content = b"".join(gzip.open(f).read() for f in files)
    assert content.count(b"WARC/1.1\r\n") == pages.count()
    got = {r.page_id: bytes(r.payload).decode() for r in read_archives(spark, f"file://{tmp_path}/a").collect() if r.payload is not None}
    want = pd.read_parquet(f"{SF}/pages.parquet").set_index("page_id").html.to_dict()
    assert got and all(want[k] == v for k, v in got.items())


def test_odd_rows(spark):
    big = "é\r\n\r\n\0" * 40_000
    rows = [(5, "u", big), (3, None, big), (9, "a b\n", big), (3, "v", big), (7, "", "short"), (8, None, "short"), (1, "w", None), (2, "x", ""), (None, "y", big), (-4, "z", "z" * 100), (None, None, "z" * 100)]
    got = sorted(((r.page_id is None, r.page_id or 0), r.payload_bytes, r.record_type, r.refers_to) for r in round_trip(spark.createDataFrame(rows, PAGES)).collect())
    n = len(big.encode())
    assert got == [((False, -4), 100, "response", None), ((False, 1), 0, "response", None), ((False, 2), 0, "response", None), ((False, 3), n, "response", None), ((False, 3), n, "response", None), ((False, 5), n, "revisit", 3), ((False, 7), 5, "response", None), ((False, 8), 5, "response", None), ((False, 9), n, "revisit", 3), ((True, 0), 100, "revisit", -4), ((True, 0), n, "revisit", 3)]
    assert round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_damage_is_noticed():
    good = record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert [parse(x)[1] for x in members(good + good, 5)] == [b"payload"] * 2
    with pytest.raises(ValueError, match="ends inside"):
        list(members(good + good[:-9]))
    with pytest.raises(ValueError, match="block digest"):
        parse(zlib.decompress(good, 31).replace(b"payload\r", b"paxload\r"))
    with pytest.raises(ValueError, match="length"):
        parse(zlib.decompress(good, 31)[:-4])


def test_archives_are_rolled_over_and_urls_come_back(spark, tmp_path):
    rows = [(i, f"http://x/%20a b/é?{i}", "".join(chr(97 + (i * j) % 26) for j in range(400))) for i in range(300)]
    write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), f"file://{tmp_path}/a", archive=6000, chunk=2000)
    sizes = [p.stat().st_size for p in Path(tmp_path, "a").glob("*.warc.gz")]
    assert len(sizes) > 10 and max(sizes) < 9000
    got = {r.page_id: (r.url, r.payload_bytes) for r in read_archives(spark, f"file://{tmp_path}/a").collect()}
    assert got == {i: (u, 400) for i, u, _ in rows}
