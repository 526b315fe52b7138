import random

import pandas as pd

import corpus_pipeline
from mnesis.llm.mixing import block_size

SF = "/root/testdata/sf0.01"


def test_stages_take_effect_and_keep_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        seen.append(docs.toPandas())
    raw, language, copies, clean, redacted = (x.set_index("doc_id") for x in seen)
    assert len(language) >= 0.99 * len(raw)
    assert not copies.text.duplicated().any()
    # of each set of equal texts the first stays, or a near copy before it
    assert len(copies) >= 0.95 * language.text.nunique()
    items = pd.read_parquet(f"{SF}/benchmark.parquet").text
    assert not clean.text.map(lambda t: any(x in t for x in items)).any()
    assert (~copies.loc[~copies.index.isin(clean.index)].text.map(lambda t: any(x[:30] in t for x in items))).sum() == 0
    assert set(redacted.index) == set(clean.index)
    assert not redacted.text.str.contains(r"password=[0-9a-f]{8}").any()
    same = ~clean.text.str.contains(r"(?i)password|secret|token|api_?key|AKIA|[0-9a-f]{32}")
    assert (redacted.text[same[same].index] == clean.text[same[same].index]).all()


def test_run(spark):
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert (got.taken <= 3 * got["size"]).all()
    sums = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    # a source's words are its slots' blocks: as near to its target as the points spread
    assert (sums.taken - sums.target).abs().max() <= 5 * block_size(sums.target.tolist(), 1 << 18)


def odd(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, text(60), "en", f"s{i % 3}", 1) for i in range(30)]
    rows += [(100, None, "en", "s0", None), (101, "", None, None, 0), (102, " \t", "en", "s1", 2), (103, "!!! 123", "en", "s1", 7), (None, text(40), None, None, None), (None, text(40), "en", "s2", 1), (5, rows[5][1], "en", "s2", 1), (5, rows[5][1], "en", "s2", 1), (7, text(50) + " password=abcdefghij01", "en", "s0", 1), (104, text(30_000), "en", "s1", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "doc_id AS row", "'x' AS score", "1 AS n", "2 AS leaky", "3 AS letters")


def test_stages_take_odd_rows_and_names(spark):
    rows, docs = odd(spark)
    named = corpus_pipeline.language(spark, docs, SF).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in named) == sorted((r[0] is None, r[0] or 0) for r in rows if r[0] not in (100, 101, 102, 103))
    copies = corpus_pipeline.near_copies(spark, docs, SF).collect()
    assert len(copies) == len(rows) - 2 and {100, 101, 102, 103} <= {r.doc_id for r in copies}
    item = pd.read_parquet(f"{SF}/benchmark.parquet").text[0]
    leaky = docs.unionByName(spark.createDataFrame([(None, item), (3, "kept words " + item)], "doc_id long, text string"), allowMissingColumns=True)
    clean = corpus_pipeline.benchmark_passages(spark, leaky, SF).collect()
    assert sorted(str(tuple(r)) for r in clean) == sorted(str(x) for x in rows)
    redacted = corpus_pipeline.secrets(spark, docs, SF).collect()
    assert len(redacted) == len(rows) and sum(r.text is None for r in redacted) == 1
    assert [r.text[-8:] for r in redacted if r.doc_id == 7 and "[" in r.text] == ["[assign]"]
    mixed = corpus_pipeline.mixture(spark, docs, SF).collect()
    assert len(mixed) == len(rows) and all(r.taken <= 3 * r.size for r in mixed)


def test_stages_of_an_empty_table(spark):
    _, docs = odd(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []
