"""Operator 3: toxicity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnesis.llm.common import bound_batches, byte_slices, release, text_buffer, token_hashes


PREFIXES = (5, 6, 7)


def value(count: np.ndarray) -> np.ndarray:
    """What a feature that stands so often in a text counts: 1, 1.58, 2, 2.32 and so on."""
    return np.log2(1 + count)


@dataclass
class Ordinal:
    """P(grade >= k) = logistic(w . x - threshold[k - 1]): one weight vector for all of the ordered thresholds. x: how often a text has each token and token prefix (see value)."""

    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.thresholds - z[:, None], -40, 40)))

    def linear(self, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
        """w . x of each text."""
        sieve = np.zeros(1 << 16, bool)
        sieve[self.features & np.uint64(0xFFFF)] = True
        at = np.flatnonzero(sieve[tokens & np.uint64(0xFFFF)])
        place = np.minimum(np.searchsorted(self.features, tokens[at]), max(0, len(self.features) - 1))
        hit = self.features[place] == tokens[at] if len(self.features) else np.zeros(0, bool)
        text = np.searchsorted(first, at[hit], "right") - 1
        if not len(text):
            return np.zeros(len(first) - 1)
        pairs, count = np.unique(text * len(self.features) + place[hit], return_counts=True)
        return np.bincount(pairs // len(self.features), self.weights[pairs % len(self.features)] * value(count), len(first) - 1)


def fit_ordinal(texts: list[np.ndarray], counts: list[np.ndarray], grades: np.ndarray, n_grades: int, l2: float = 1e-4, l1: float = 1e-4, steps: int = 250, rate: float = 0.1, least: int = 4) -> Ordinal:
    """Adam on the likelihood of the grades; clean texts weigh 0.85 in all, the others 0.15. texts: each one's distinct features, with counts; a feature stands in `least` texts or more."""
    flat = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    x = value(np.concatenate(counts)) if counts else np.zeros(0)
    features, col, seen = np.unique(flat, return_inverse=True, return_counts=True)
    keep = seen >= least
    number = np.cumsum(keep) - 1
    ok = keep[col]
    row, col, x, features = row[ok], number[col[ok]], x[ok], features[keep]
    w, theta = np.zeros(len(features)), np.arange(n_grades - 1, dtype=float)
    bad = grades > 0
    sample = np.where(bad, 0.15 / max(1, bad.sum()), 0.85 / max(1, (~bad).sum()))
    state = [[np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(theta), np.zeros_like(theta)]]
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col] * x, len(texts))
        p = 1 / (1 + np.exp(np.clip(theta - z[:, None], -40, 40)))
        # P(grade) is the difference of two neighbours; its gradient goes through both
        edge = np.concatenate([np.ones((len(z), 1)), p, np.zeros((len(z), 1))], 1)
        i = np.arange(len(z))
        mass = np.maximum(edge[i, grades] - edge[i, grades + 1], 1e-9)
        slope = edge * (1 - edge)
        gz = -(slope[i, grades] - slope[i, grades + 1]) / mass * sample
        gt = np.zeros((len(z), n_grades + 1))
        gt[i, grades] += slope[i, grades] / mass * sample
        gt[i, grades + 1] -= slope[i, grades + 1] / mass * sample
        for param, g, (m, v) in zip((w, theta), (np.bincount(col, gz[row] * x, len(w)) + l2 * w, gt[:, 1:-1].sum(0)), state, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            param -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w[:] = np.sign(w) * np.maximum(0, np.abs(w) - rate * l1 * 100)  # the steps of Adam are about rate long, whatever the gradient
        np.maximum.accumulate(theta, out=theta)
    used = np.abs(w) > 1e-6
    return Ordinal(features[used], w[used], theta)


def severity_grades(texts: list[np.ndarray], toxic: np.ndarray, levels: int = 3, least: int = 4) -> np.ndarray:
    """Ordered grades from 0/1 labels: 0 for clean texts; toxic ones by how many features they hold that stand almost only in toxic texts, cut at equal shares."""
    flat = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
    owner = np.repeat(toxic, [len(t) for t in texts])
    tokens, where = np.unique(flat, return_inverse=True)
    bad = np.bincount(where, owner, len(tokens)) / max(1, toxic.sum())
    good = np.bincount(where, ~owner, len(tokens)) / max(1, (~toxic).sum())
    seen = np.bincount(where, minlength=len(tokens))
    marker = (seen >= least) & (bad > 10 * good)
    strength = np.bincount(np.repeat(np.arange(len(texts)), [len(t) for t in texts]), marker[where], len(texts))
    out = np.zeros(len(texts), np.int64)
    if toxic.any():
        cuts = np.quantile(strength[toxic], np.arange(1, levels) / levels)
        out[toxic] = 1 + np.searchsorted(cuts, strength[toxic], "left")
    return out


def fit(docs: DataFrame, labels: DataFrame, n_toxic: int = 3000, n_clean: int = 5000, most_features: int = 4096) -> Ordinal | None:
    """Learn from a bounded sample of labelled texts: of each class at most n_toxic or n_clean distinct pairs of doc_id and text, those of least hash, and of each text
    at most most_features distinct features, also by least hash, so that neither repeated ids nor very long texts add to it. None if a class has none."""
    bound_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("toxic") > 0).alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL")
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), "text")
    pairs = keyed.select("id", "h").join(known, "id").distinct()
    draw = lambda want, n: [tuple(r) for r in pairs.where(F.col("toxic") == want).orderBy(F.xxhash64("id"), "id", "h").limit(n).select("id", "h", "toxic").collect()]
    chosen = docs.sparkSession.createDataFrame(draw(True, n_toxic) + draw(False, n_clean), "id long, h long, toxic boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                tokens, first = token_hashes(*text_buffer(part.column("text")), PREFIXES)
                out = [tuple(x[:most_features] for x in np.unique(tokens[first[i] : first[i + 1]], return_counts=True)) for i in range(part.num_rows)]
                packed = [pa.array([x.tobytes() for x, _ in out], pa.binary()), pa.array([n.clip(max=65535).astype(np.uint16).tobytes() for _, n in out], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), part.column("toxic"), *packed], names=["id", "h", "toxic", "tokens", "counts"])

    # at most n_toxic + n_clean texts of bounded size
    rows = keyed.join(F.broadcast(chosen), ["id", "h"]).mapInArrow(run, "id long, h long, toxic boolean, tokens binary, counts binary").dropDuplicates(["id", "h"]).toArrow()
    # copies of one text would teach all of its words: each set of tokens counts once
    once = sorted(set(zip(*(rows.column(c).to_pylist() for c in ("tokens", "counts", "toxic")), strict=True)))
    toxic = np.array([y for _, _, y in once], bool)
    if not toxic.any() or toxic.all():
        return None
    texts, counts = [np.frombuffer(t, np.uint64) for t, _, _ in once], [np.frombuffer(c, np.uint16).astype(np.int64) for _, c, _ in once]
    least = max(4, int(toxic.sum()) // 30)
    grades = severity_grades(texts, toxic, least=least)
    return fit_ordinal(texts, counts, grades, int(grades.max()) + 1, least=least)


def score_toxicity(docs: DataFrame, labels: DataFrame, model: Ordinal | None = None) -> DataFrame:
    """doc_id, severity (expected grade), grade (most likely) and toxic (grade 1 or above is likelier than not) of each document.

    A null or blank text has severity 0. Labels that are null or have no document, and repeated labels of one document (its highest counts), are no error; without
    labels of both kinds all severities are 0. Repeated rows are scored each. Extra columns are ignored. One pass, no shuffle; features are looked up, not
    hashed into slots, so that long texts collect no chance weights.
    """
    model = model or fit(docs, labels)
    release()
    plain = docs.select(F.col("doc_id").cast("long"), "text")
    if model is None:
        return plain.select("doc_id", F.lit(0.0).alias("severity"), F.lit(0).alias("grade"), F.lit(False).alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                tokens, first = token_hashes(*text_buffer(part.column("text")), PREFIXES)
                p = model.at_least(model.linear(tokens, first))
                p[np.diff(first) == 0] = 0
                edge = np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], 1)
                grade = (edge[:, :-1] - edge[:, 1:]).argmax(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p.sum(1)), pa.array(grade), pa.array(p[:, 0] >= 0.5)], names=["doc_id", "severity", "grade", "toxic"])

    return plain.mapInArrow(run, "doc_id long, severity double, grade int, toxic boolean")
