"""Evaluation of rankings: recall, NDCG, reciprocal ranks, paired gates, baselines, scale curves."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnesis.model import DEFAULT, Params

KS = (1, 3, 5, 10, 30, 50)


def per_question(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """qid, k, recall_any, recall_all and ndcg of each question with gold (qid, id). ranked: qid, id, rank. Questions without gold are left out."""
    n = gold.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    hits = gold.join(ranked.select("qid", "id", "rank"), ["qid", "id"], "left").select("qid", "rank").withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    got = F.coalesce(F.col("rank") <= F.col("k"), F.lit(False))
    per = hits.groupBy("qid", "k").agg(F.count_if(got).alias("hit"), F.sum(F.when(got, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg")).join(n, "qid")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", "k").cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return per.select("qid", "k", (F.col("hit") > 0).cast("double").alias("recall_any"), (F.col("hit") == F.col("n")).cast("double").alias("recall_all"), (F.col("dcg") / ideal).alias("ndcg"))


def means(per: DataFrame, *by: str) -> DataFrame:
    """The measures' means over questions (6 digits), and how many there are, for each k and whatever else is given."""
    return per.groupBy(*by, "k").agg(F.count(F.lit(1)).alias("questions"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall_any", "recall_all", "ndcg")])


def _best(k: int):
    def best(asked: pa.Table, rows: pa.Table) -> pa.Table:
        units = []
        for t, name in ((asked, "asked"), (rows, "held")):
            x = t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            units.append(np.divide(x, norm, out=np.zeros_like(x), where=norm > 0))
        qids, ids = asked.column("qid").to_numpy(), rows.column("id").to_numpy()
        out: list[list[np.ndarray]] = [[], [], []]
        if len(qids) and len(ids):
            cos = np.floor(units[0] @ units[1].T * 1e6 + 0.5) / 1e6
            for q, c in zip(qids, cos, strict=True):
                ok = np.flatnonzero(ids != q)
                if len(ok) > k:  # all that are no worse than the k-th, ties included, are sorted
                    ok = ok[c[ok] >= np.partition(c[ok], len(ok) - k)[len(ok) - k]]
                top = ok[np.lexsort((ids[ok], -c[ok]))[:k]]
                for x, y in zip(out, (np.full(len(top), q), ids[top], c[top]), strict=True):
                    x.append(y)
        a, b, c = (np.concatenate(x) if x else np.zeros(0) for x in out)
        return pa.table({"pool": pa.array(np.resize(asked.column("pool").to_numpy() if len(qids) else np.zeros(1), len(a)), pa.int64()), "qid": pa.array(a, pa.int64()), "id": pa.array(b, pa.int64()), "cos": pa.array(c, pa.float64())})

    return best


def ranked(questions: DataFrame, rows: DataFrame, k: int = 50, asked: int = 512, block: int = 8192) -> DataFrame:
    """pool, qid, id, rank and cos (6 digits) of the k rows nearest to each question within its pool, ties to the smaller id; a row whose id is the question's is left out.

    questions: pool, qid, embedding; rows: pool, id, embedding, of one dimension; what has no vector or pool takes no part. Of each pool, blocks of about `asked` questions
    meet blocks of about `block` rows as matrix products, whose size no pool changes; each gives k rows a question. Nothing is collected.
    """
    questions, rows = (x.where(F.col("embedding").isNotNull() & F.col("pool").isNotNull()).withColumn("pool", F.col("pool").cast("long")) for x in (questions, rows))
    many = lambda df, n, name: df.groupBy("pool").agg(F.ceil(F.count(F.lit(1)) / n).cast("int").alias(name))
    blocks = many(questions, asked, "qs").join(many(rows, block, "rs"), "pool")
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = questions.join(blocks, "pool").select("pool", F.col("qid").cast("long"), F.col("embedding").alias("asked"), place("qid", "qs").alias("q"), all_of("rs").alias("r"))
    r = rows.join(blocks, "pool").select("pool", F.col("id").cast("long"), F.col("embedding").alias("held"), all_of("qs").alias("q"), place("id", "rs").alias("r"))
    got = q.groupBy("pool", "q", "r").cogroup(r.groupBy("pool", "q", "r")).applyInArrow(_best(k), "pool long, qid long, id long, cos double")
    order = F.row_number().over(Window.partitionBy("pool", "qid").orderBy(F.desc("cos"), "id"))
    return got.withColumn("rank", order).where(F.col("rank") <= k).select("pool", "qid", "id", "rank", "cos")


def within(ranked: DataFrame, candidates: DataFrame) -> DataFrame:
    """The ranking with what is not among a question's candidates (qid, id) taken out, numbered anew."""
    kept = ranked.join(candidates, ["qid", "id"], "left_semi")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "id")))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, length, term and tf of the distinct words of each row (id, words)."""
    for batch in batches:
        words = batch.column("words")
        size = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        if len(coded):
            row, code = np.divmod(np.repeat(np.arange(len(size)), size) * len(coded.dictionary) + coded.indices.to_numpy(), len(coded.dictionary))
            order = np.lexsort((code, row))
            row, code = row[order], code[order]
            at = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])])
            tf = np.diff(np.r_[at, len(row)])
            for k in range(0, len(at), 65536):
                x = at[k : k + 65536]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row[x])), pa.array(size[row[x]]), coded.dictionary.take(pa.array(code[x])), pa.array(tf[k : k + 65536])], names=["id", "length", "term", "tf"])


def _scored(top: int, k1: float, b: float):
    def scored(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        terms = asked.column("term").unique()
        code = pc.index_in(rows.column("term"), value_set=terms)
        known = pc.is_valid(code)
        rows, code = rows.filter(known), code.filter(known).to_numpy()
        if rows.num_rows:
            qids, of = np.unique(asked.column("qid").to_numpy(), return_inverse=True)
            weight = np.zeros((len(terms), len(qids)))
            has = np.zeros(weight.shape, np.float32)
            place = pc.index_in(asked.column("term"), value_set=terms).to_numpy()
            np.add.at(weight, (place, of), asked.column("weight").to_numpy())
            has[place, of] = 1
            tf, length, mean = (rows.column(c).to_numpy().astype(float) for c in ("tf", "length", "mean"))
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
            ids, doc = np.unique(rows.column("id").to_numpy(), return_inverse=True)
            order = np.argsort(doc, kind="stable")
            cuts = np.searchsorted(doc[order], np.arange(0, len(ids) + 512, 512))
            for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):  # a matrix of 512 docs at once
                x, own = order[i:j], ids[k * 512 : (k + 1) * 512]
                counts = np.zeros((len(own), len(terms)))
                np.add.at(counts, (doc[x] - k * 512, code[x]), part[x])
                score, met = np.floor(counts @ weight * 1e6 + 0.5) / 1e6, (counts > 0).astype(np.float32) @ has > 0
                for q in range(len(qids)):
                    ok = np.flatnonzero(met[:, q])
                    s = score[ok, q]
                    best = np.lexsort((own[ok], -s))[:top]
                    for y, z in zip(out, (np.full(len(best), qids[q]), own[ok[best]], s[best]), strict=True):
                        y.append(z)
        q, i, s = (np.concatenate(x) if x else np.zeros(0) for x in out)
        if len(q):
            order = np.lexsort((i, -s, q))
            q, i, s = q[order], i[order], s[order]
            first = np.arange(len(q)) - np.searchsorted(q, q) < top
            q, i, s = q[first], i[first], s[first]
        return pa.table({"qid": pa.array(q, pa.int64()), "id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})

    return scored


def bm25(questions: DataFrame, docs: DataFrame, top: int = 50, k1: float = 1.5, b: float = 0.75, floor: float = 0.25, block: int = 4096, at_once: int = 512) -> DataFrame:
    """qid, id, rank and score (6 digits) of the `top` best docs (id, text) for each question (qid, text) by Okapi's BM25 over words in lower case, split at white space. A term
    that over half of the docs have weighs `floor` times the mean weight of all terms.

    A doc's words are counted where it is read. All terms' numbers of docs are added up before they are shuffled; of the counts only those of terms that some question has
    go on, to blocks of about `block` docs, which meet blocks of about `at_once` questions as a matrix product. Each gives `top` rows a question."""
    split = lambda c: F.filter(F.split(F.lower(F.col(c)), r"\s+"), lambda x: x != "")
    asked = questions.select(F.col("qid").cast("long").alias("qid"), F.explode(split("text")).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("n"))
    words = docs.select(F.col("id").cast("long").alias("id"), split("text").alias("words"))
    tf = words.mapInArrow(_counted, "id long, length long, term string, tf long")
    size = words.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size("words")).alias("mean"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(size))
    raw = df.withColumn("raw", F.log(F.col("docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    usual = raw.agg(F.avg("raw").alias("usual"))
    idf = raw.join(asked.select("term").distinct(), "term", "left_semi").crossJoin(F.broadcast(usual)).select("term", F.when(F.col("raw") < 0, F.lit(floor) * F.col("usual")).otherwise(F.col("raw")).alias("idf"))
    blocks = size.select("mean", F.greatest(F.lit(1.0), F.ceil(F.col("docs") / block)).cast("int").alias("rs")).crossJoin(F.broadcast(questions.agg(F.greatest(F.lit(1.0), F.ceil(F.count(F.lit(1)) / at_once)).cast("int").alias("qs"))))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(idf, "term").crossJoin(F.broadcast(blocks)).select("qid", "term", (F.col("n") * F.col("idf")).alias("weight"), place("qid", "qs").alias("q"), all_of("rs").alias("r"))
    right = tf.join(asked.select("term").distinct(), "term", "left_semi").crossJoin(F.broadcast(blocks)).select("id", "length", "term", "tf", "mean", all_of("qs").alias("q"), place("id", "rs").alias("r"))
    got = left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInArrow(_scored(top, k1, b), "qid long, id long, score double")
    order = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("id")))
    return got.withColumn("rank", order).where(F.col("rank") <= top).select("qid", "id", "rank", "score")


def mcnemar(b: int, c: int) -> float:
    """Exact two-sided p-value of b and c discordant pairs."""
    n = b + c
    return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n)


def mcnemar_p(b: Column, c: Column) -> Column:
    """mcnemar() of columns: the tail of a fair binomial as its last term times the sum of the others' ratios to it, some 6 sqrt(b + c) steps.

    Of n = b + c, the term j places before the last is at most exp(-2 j^2 / n) of it: those left out are less than a double can tell from the sum. The last term of up to a
    thousand pairs is a product from 2^-n on; of more it is Stirling's, whose exponents are small, so that no digits cancel.
    """
    n, k = (b + c).cast("double"), F.least(b, c).cast("double")
    upto = lambda m: F.sequence(F.lit(0).cast("long"), F.greatest(m, F.lit(1.0)).cast("long") - 1)  # noqa: E731 - at least one step, which adds nothing where m is 0
    product = F.aggregate(upto(F.least(k, F.lit(500.0))), F.pow(F.lit(2.0), -n), lambda t, j: F.when(j < k, t * (n - j) / (j + 1.0)).otherwise(t))
    x, y = F.greatest(k, F.lit(1.0)), n - F.greatest(k, F.lit(1.0))
    rest = lambda v: 1 / (12.0 * v) - 1 / (360.0 * v * v * v) + 1 / (1260.0 * v * v * v * v * v)
    stirling = F.sqrt(n / (2 * math.pi * x * y)) * F.exp(rest(n) - rest(x) - rest(y) - x * F.log1p((x - y) / n) - y * F.log1p((y - x) / n))
    state = lambda term, total: F.struct(term.alias("term"), total.alias("total"))
    ratio = lambda s, j: s["term"] * (k - j) / (n - k + j + 1.0)
    ratios = F.aggregate(upto(F.least(k, F.ceil(6 * F.sqrt(n)).cast("double"))), state(F.lit(1.0), F.lit(1.0)), lambda s, j: state(ratio(s, j), s["total"] + ratio(s, j)))["total"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.when(n <= 1000, product).otherwise(stirling) * ratios))


def paired_gate(hits: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """For each mutant of rows (mutant, qid, base, hit), booleans: n, the discordant pairs, both precisions, delta, p-value and whether it passes: delta of gate_delta at least and
    p below gate_alpha."""
    each = hits.groupBy("mutant").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("base") & ~F.col("hit")).alias("only_base"), F.count_if(~F.col("base") & F.col("hit")).alias("only_mutant"), F.avg(F.col("base").cast("double")).alias("base"), F.avg(F.col("hit").cast("double")).alias("mutated"))
    each = each.withColumns({"delta": F.col("mutated") - F.col("base"), "p_value": mcnemar_p(F.col("only_base"), F.col("only_mutant"))})
    passed = (F.round("delta", 9) >= p.gate_delta) & (F.col("p_value") < p.gate_alpha)
    return each.select("mutant", "n", "only_base", "only_mutant", *[F.round(c, 4).alias(c) for c in ("base", "mutated", "delta", "p_value")], passed.alias("gate_pass"))


def mutation_ladder(p: Params = DEFAULT) -> list[tuple[str, Params]]:
    """Small steps around the parameters: rrf_k by 10 and 20 within 30..100, the tiers web and cron by 0.05 and 0.1 within 0.6..1."""
    out = [(f"rrf_k={k}", replace(p, rrf_k=k)) for k in (p.rrf_k - 20, p.rrf_k - 10, p.rrf_k + 10, p.rrf_k + 20) if 30 <= k <= 100]
    for tier in ("web", "cron"):
        for v in (round(p.tier[tier] + d, 3) for d in (-0.1, -0.05, 0.05, 0.1)):
            if 0.6 <= v <= 1.0:
                out.append((f"tier.{tier}={v}", replace(p, tier=p.tier | {tier: v})))
    return out


def mutant_hits(routes: DataFrame, gold: DataFrame, ladder: list[tuple[str, Params]], p: Params = DEFAULT, k: int = 5) -> DataFrame:
    """mutant, qid, base and hit: whether a gold row is among the first k of the fused ranks with the usual parameters, and with each mutant's. routes: qid, id, tier and
    the ranks vector and text (null: not found there). All mutants are rows, so that one job fuses them all."""
    params = [("", p), *ladder]
    rows = routes.sparkSession.createDataFrame([(n, float(x.rrf_k), float(x.w_vector), float(x.w_text), {t: float(w) for t, w in x.tier.items()}) for n, x in params], "mutant string, k double, wv double, wt double, tiers map<string,double>")
    part = lambda w, r: F.coalesce(F.col(w) / (F.col("k") + F.col(r)), F.lit(0.0))
    score = F.round((part("wv", "vector") + part("wt", "text")) * F.coalesce(F.element_at("tiers", F.col("tier")), F.lit(1.0)), 9)
    fused = routes.crossJoin(F.broadcast(rows)).withColumn("score", score)  # a few mutants
    first = fused.withColumn("rank", F.row_number().over(Window.partitionBy("mutant", "qid").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    hit = first.join(gold.withColumn("g", F.lit(True)), ["qid", "id"], "left").groupBy("mutant", "qid").agg(F.coalesce(F.max("g"), F.lit(False)).alias("hit"))
    base = hit.where("mutant = ''").select("qid", F.col("hit").alias("base"))
    return hit.where("mutant <> ''").join(base, "qid").select("mutant", "qid", "base", "hit")


def reciprocal(ranked: DataFrame, gold: DataFrame, scene: DataFrame | None = None) -> DataFrame:
    """One row: questions, P@5 and MRR@10 of the best gold row (6 digits), and P@5 of rows of the gold's scene (scene: id, scene) if that is given."""
    best = gold.join(ranked, ["qid", "id"], "left").groupBy("qid").agg(F.min("rank").alias("r"))
    if scene is not None:
        of_gold = gold.join(scene, "id").select("qid", "scene").distinct()
        same = ranked.join(scene, "id").join(of_gold, ["qid", "scene"]).groupBy("qid").agg(F.min("rank").alias("s"))
        best = best.join(same, "qid", "left")
    else:
        best = best.withColumn("s", F.col("r"))
    share = lambda c, k: F.round(F.avg(F.coalesce((F.col(c) <= k).cast("double"), F.lit(0.0))), 6)
    return best.agg(F.count(F.lit(1)).alias("questions"), share("r", 5).alias("p5"), F.round(F.avg(F.when(F.col("r") <= 10, 1.0 / F.col("r")).otherwise(0.0)), 6).alias("mrr"), share("s", 5).alias("p5_scene"))


def decay_curve(questions: DataFrame, rows: DataFrame, gold: DataFrame, order: DataFrame, sizes: tuple[int, ...], k: int = 5) -> DataFrame:
    """size, questions, recall: recall_any at k over nested corpora, the first `size` rows in a shuffled order (id, place: of the largest size at least); gold rows are in each of
    them. questions: qid, embedding; rows: id, embedding. A corpus holds its size and the gold rows, and only the k first of each question are ranked."""
    each = F.explode(F.array(*map(F.lit, sizes))).alias("pool")
    corpora = order.select("id", "place", each).where(F.col("place") <= F.col("pool")).select("id", "pool").union(gold.select("id").distinct().select("id", each)).distinct()
    first = ranked(questions.select("qid", "embedding", each), rows.join(corpora, "id"), k)
    hit = first.join(gold, ["qid", "id"], "left_semi").select("pool", "qid").distinct().withColumn("hit", F.lit(1.0))
    all_ = gold.join(rows.select("id"), "id", "left_semi").where(F.col("id") != F.col("qid")).select("qid").distinct().select("qid", each)
    return all_.join(hit, ["pool", "qid"], "left").groupBy(F.col("pool").alias("size")).agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("recall"))


def rank_diff(before: DataFrame, after: DataFrame, top: int = 5) -> DataFrame:
    """One row: how many of the first `top` places hold another row, and whether none does. before, after: id, rank."""
    a, b = (x.where(F.col("rank") <= top).select("rank", F.col("id").alias(n)) for x, n in ((before, "a"), (after, "b")))
    return a.join(b, "rank", "full").agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("moved")).withColumn("same_order", F.col("moved") == 0)


def pick_questions(memories: DataFrame, scene: Column, least: int = 8, most: int = 36) -> DataFrame:
    """id and scene: of each scene of `least` characters or more the row of greatest priority, then latest creation; the `most` first of them in that order."""
    rows = memories.withColumn("scene", F.trim(scene)).where(F.length("scene") >= least)
    best = rows.groupBy("scene").agg(F.max(F.struct("priority", "created_at", (-F.col("id")).alias("minus"))).alias("b"))
    return best.orderBy(F.desc("b.priority"), F.desc("b.created_at"), F.desc("b.minus")).limit(most).select((-F.col("b.minus")).alias("id"), "scene")
