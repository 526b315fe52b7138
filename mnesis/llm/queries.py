"""The registered queries of this subpackage: thin opN_<name> functions over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnesis.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnesis.llm.langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnesis.llm.toxicity import score_toxicity

    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnesis.llm.warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnesis.llm.secrets import digest, find_secrets

    return digest(find_secrets(_table(spark, sf_dir, "documents")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnesis.llm.decontamination import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnesis.llm.topk import top_k

    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(64 * x.cast("double")).cast("double")).alias("x"), "embedding")
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return top_k(rows.where(F.col("embedding").isNotNull() & finite).select("vec_id", "x"), F.col("vec_id") % 20 == 0, k=20)


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from mnesis.llm.tokens import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnesis.llm.substrings import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), window=20)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnesis.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnesis.llm.exact import exact_duplicates

    return exact_duplicates(_table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnesis.llm.trie import grafted_trie

    return grafted_trie(_table(spark, sf_dir, "conversations"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnesis.llm.manifest import manifest

    return manifest(_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(strlen(html), 0) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""


OP11_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, sha256(n.body) AS text_sha256
FROM n JOIN g ON n.body = g.body
"""


def crc32_sql(text: str) -> str:
    """DuckDB has no crc32: the unsigned one of an ASCII text, a bit at a time."""
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce([4294967295] || list_transform(string_split({text}, ''), lambda z: CAST(ascii(z) AS BIGINT)), lambda c, b: {step}), 4294967295)"


OP12_SQL = rf"""
WITH o AS (
  SELECT conv_id, sha256(strlen(role) || ':' || role || text) AS s, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS k
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
),
c AS (SELECT conv_id, count(*) AS n, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h, conv_id - conv_id % 20 AS b FROM o GROUP BY conv_id),
t AS (
  SELECT c.conv_id, o.k AS i, s, words FROM c JOIN o ON o.conv_id = c.b AND o.k <= c.h
  UNION ALL SELECT c.conv_id, o.k - c.h + least(c.h, coalesce(d.n, 0)), s, words FROM c JOIN o ON o.conv_id = c.conv_id AND o.k > c.h LEFT JOIN c d ON d.conv_id = c.b
  UNION ALL SELECT conv_id, 0, '', 0 FROM c
),
p AS (SELECT conv_id, i, words, list(s) OVER (PARTITION BY conv_id ORDER BY i) AS path, max(i) OVER (PARTITION BY conv_id) AS n FROM t),
v AS (SELECT path, min(conv_id) AS conv_id, min(i) AS depth, count(*) AS n_convs, min(words) AS words, coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (i = n), '') AS ends FROM p GROUP BY path),
k AS (SELECT path[:-2] AS path, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY 1),
a AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN k USING (path)),
u AS (SELECT path[:d] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens FROM (SELECT *, unnest(range(1, depth + 2)) AS d FROM a) GROUP BY 1)
SELECT a.conv_id, a.depth, v.conv_id AS parent_conv_id, a.n_convs, a.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM a JOIN u USING (path) LEFT JOIN v ON v.path = a.path[:-2] AND a.depth > 0
"""


def _op13_sql(levels: int = 6) -> str:
    """The tree level by level: n nodes of a source become n/16, and those of one stay; enough levels for 16^levels leaves of a source, and as many sources."""
    fields = lambda text: " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    small = "CASE WHEN bad THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    out = [
        f"b AS (SELECT *, coalesce({crc32_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0, false) AS bad FROM documents)",
        f"h AS (SELECT doc_id, source, sha256({fields('text')}) AS leaf, sha256({fields('(' + small + ')')}) AS other FROM b)",
        "s0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM h)",
        "a0 AS (SELECT source AS g, i, n, leaf AS d FROM s0)",
        "p0 AS (SELECT doc_id, leaf, source AS g, i, other AS f, '' AS proof FROM s0)",
    ]
    for t, first in (("", 0), ("t", 0)):
        if t:
            out.append(f"ta0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n, d, g AS source FROM a{levels})")
            out.append(f"tp0 AS (SELECT p.doc_id, p.leaf, x.d AS subroot, 0 AS g, x.i, p.f, p.proof FROM p{levels} p JOIN ta0 x ON p.g IS NOT DISTINCT FROM x.source)")
        for k in range(first, levels):
            out.append(f"{t}r{k} AS (SELECT g, i // 16 AS i, n, string_agg(d, '' ORDER BY i) AS run FROM {t}a{k} GROUP BY g, i // 16, n)")
            out.append(f"{t}a{k + 1} AS (SELECT g, i, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN run ELSE sha256(run) END AS d FROM {t}r{k})")
            sub = "p.subroot, " if t else ""
            out.append(
                f"{t}p{k + 1} AS (SELECT p.doc_id, p.leaf, {sub}p.g, p.i // 16 AS i, "
                "CASE WHEN r.n = 1 THEN p.f ELSE sha256(left(r.run, 64 * (p.i % 16)) || p.f || substr(r.run, 64 * (p.i % 16) + 65)) END AS f, "
                "CASE WHEN r.n = 1 THEN p.proof ELSE p.proof || left(r.run, 64 * (p.i % 16)) || substr(r.run, 64 * (p.i % 16) + 65) END AS proof "
                f"FROM {t}p{k} p JOIN {t}r{k} r ON p.g IS NOT DISTINCT FROM r.g AND p.i // 16 = r.i)"
            )
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, a.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = a.d AS verified FROM tp{levels} CROSS JOIN ta{levels} a"


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": OP4_SQL, "op7_topk": OP7_SQL, "op11_exact_dedup": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_merkle": _op13_sql()}
