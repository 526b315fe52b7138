"""Operator 2: language identification by a byte convolutional network, trained in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from mnesis.llm.common import bound_batches, byte_slices, free_name, text_buffer

UNDETERMINED = "und"


@dataclass
class ByteNet:
    """Embedding of bytes, filters of several widths, the maximum of each over a window, softmax."""

    classes: list[str]
    tables: list[np.ndarray]  # for each width: (width, 256, filters), the filter's part for each byte at each place
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    window: int

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """windows: (n, window) bytes, 0 after a text's end. Table look-ups stand for embedding and filters: few additions for each byte."""
        pooled, at = np.empty((len(windows), len(self.bias)), np.float32), 0
        for table in self.tables:
            width, _, filters = table.shape
            places = self.window - width + 1
            total = np.take(table[0], windows[:, :places], axis=0)
            for k in range(1, width):
                total += np.take(table[k], windows[:, k : k + places], axis=0)
            pooled[:, at : at + filters] = total.max(1)
            at += filters
        hidden = np.maximum(pooled + self.bias, 0)
        z = hidden @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, classes: list[str], widths: tuple[int, ...] = (2, 3, 4), filters: int = 12, size: int = 8, epochs: int = 6, batch: int = 64, rate: float = 4e-3, seed: int = 0) -> ByteNet:
    """Adam on the cross entropy of windows (n, window) of bytes; classes weigh alike."""
    rng = np.random.default_rng(seed)
    window, f = windows.shape[1], filters * len(widths)
    p = {"e": rng.normal(0, 0.5, (256, size)), "b": np.zeros(f), "o": rng.normal(0, 1 / np.sqrt(f), (f, len(classes))), "c": np.zeros(len(classes))}
    p |= {f"w{w}": rng.normal(0, 1 / np.sqrt(w * size), (w * size, filters)) for w in widths}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    weight = len(labels) / (len(classes) * np.maximum(1, np.bincount(labels, minlength=len(classes))))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for start in range(0, len(order), batch):
            i = order[start : start + batch]
            x, y, n = windows[i], labels[i], len(i)
            e = p["e"][x]
            g = {k: np.zeros_like(a) for k, a in p.items()}
            cols, tops, kept = [], [], []
            for w in widths:
                wide = np.lib.stride_tricks.sliding_window_view(e, w, 1).swapaxes(2, 3).reshape(n, window - w + 1, w * size)
                a = wide @ p[f"w{w}"]
                top = a.argmax(1)
                cols.append(np.take_along_axis(a, top[:, None], 1)[:, 0])
                tops.append(top)
                kept.append(wide)
            pre = np.concatenate(cols, 1) + p["b"]
            h = np.maximum(pre, 0)
            z = h @ p["o"] + p["c"]
            z = np.exp(z - z.max(1, keepdims=True))
            d = z / z.sum(1, keepdims=True)
            d[np.arange(n), y] -= 1
            d *= (weight[y] / n)[:, None].astype(np.float32)
            g["o"], g["c"] = h.T @ d, d.sum(0)
            dh = (d @ p["o"].T) * (pre > 0)
            g["b"] = dh.sum(0)
            for j, w in enumerate(widths):
                part = dh[:, j * filters : (j + 1) * filters]
                hit = np.take_along_axis(kept[j], tops[j][:, :, None], 1)  # (n, filters, w * size)
                g[f"w{w}"] = np.einsum("nfk,nf->kf", hit, part)
                back = part[:, :, None] * p[f"w{w}"].T[None]  # (n, filters, w * size)
                at = tops[j][:, :, None] + np.arange(w)
                np.add.at(g["e"], x[np.arange(n)[:, None, None], at].ravel(), back.reshape(-1, size))
            step += 1
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] ** 2 - v[k])
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    tables = [np.ascontiguousarray((p["e"] @ p[f"w{w}"].reshape(w, size, filters))).astype(np.float32) for w in widths]
    return ByteNet(classes, tables, p["b"], p["o"], p["c"], window)


def cut_windows(raw: np.ndarray, offs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts as windows (n, window), and each window's text. The last window of a long text ends with it; a short text is filled up with zeros."""
    length = np.diff(offs)
    n = -(-length // window)
    text = np.repeat(np.arange(len(length)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    start = np.minimum(k * window, np.maximum(0, length[text] - window))
    place = start[:, None] + np.arange(window)
    inside = place < length[text][:, None]
    return np.where(inside, raw[np.minimum(offs[:-1][text][:, None] + place, max(0, len(raw) - 1))], 0), text


def is_held_out(doc_id: Column) -> Column:
    """The rule that keeps a document out of the training: crc32 of its id as text has remainder 1 by 3. A null id is never learnt from, nor held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, per_language: int = 1500, window: int = 256, max_languages: int = 1000) -> ByteNet | None:
    """Learn from at most per_language documents of each language (a bounded sample by hash of text and id), up to two windows of each; None if nothing is labelled.

    Only rows with text, a lang and an id that is_held_out() leaves are seen.
    """
    known = docs.where(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long"), "text", "lang")
    counts = known.groupBy("lang").count().limit(max_languages + 1).collect()
    if not counts:
        return None
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    # a share by hash that gives a little over per_language rows of each, whatever their number
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], 1.2 * per_language / r["count"] + 20 / r["count"]).otherwise(share)
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < share * (1 << 30))
    # two windows' worth of characters from a place by hash: the whole text may be long
    width = F.char_length("text")
    place = (F.pmod(F.xxhash64("doc_id", F.lit(9)), F.greatest(F.lit(1), width - 2 * window)) + 1).cast("int")
    rows = drawn.select("doc_id", "lang", F.col("text").substr(place, F.lit(2 * window)).alias("piece"), "text").select("doc_id", "lang", "piece").orderBy(F.xxhash64("doc_id", "piece"), "doc_id", "piece").limit(2 * per_language * len(counts) + 40 * len(counts)).collect()
    classes = sorted(r["lang"] for r in counts)
    number = {c: k for k, c in enumerate(classes)}
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.piece))
    seen: dict[str, int] = dict.fromkeys(classes, 0)
    pieces, labels = [], []
    for r in rows:
        if seen[r["lang"]] < per_language:
            seen[r["lang"]] += 1
            pieces.append(r.piece)
            labels.append(number[r["lang"]])
    raw, offs = text_buffer(pa.array(pieces, pa.string()))
    windows, text = cut_windows(raw, offs, window)
    return train(windows, np.array(labels)[text], classes)


def predict(docs: DataFrame, net: ByteNet | None, batch: int = 64) -> DataFrame:
    """The docs' columns with lang_pred and score: the mean of the probabilities of all windows of the whole text. und (score 0): null, no letter, or nothing learnt. Columns of the docs with one of these names are replaced."""
    docs = docs.drop("lang_pred", "score")
    if net is None:
        return docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    bound_batches(docs.sparkSession)
    window, letters = net.window, free_name("letters", docs.columns)
    marked = docs.withColumn(letters, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = StructType([*marked.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in byte_slices(whole, "text", 1 << 20):
                raw, offs = text_buffer(part.column("text"))
                total = np.zeros((part.num_rows, len(net.classes)))
                windows, text = cut_windows(raw, offs, window)
                for i in range(0, len(windows), batch):
                    np.add.at(total, text[i : i + batch], net.probabilities(windows[i : i + batch]))
                total /= np.maximum(1, np.bincount(text, minlength=part.num_rows))[:, None]
                best = total.argmax(1)
                ok = np.array([bool(x) for x in part.column(letters).to_pylist()], bool)
                pred = np.where(ok, np.array(net.classes, object)[best], UNDETERMINED)
                score = np.clip(np.where(ok, total[np.arange(len(best)), best], 0.0), 0, 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score)], names=[*part.schema.names, "lang_pred", "score"])

    return marked.mapInArrow(run, schema).drop(letters)


def identify(docs: DataFrame, per_language: int = 1500, window: int = 256) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document; the network is learnt from the table's own labelled rows that are not held out.

    A prediction uses the text's bytes only. Null texts and texts with no letter are und with score 0, as is all if nothing is labelled; null langs are not
    learnt from. Repeated rows are predicted each. A null doc_id is not held out and not learnt from. Scale: a bounded sample trains one small network on
    the driver; prediction is one pass with no shuffle, whole texts cut into windows of equal length.
    """
    net = fit(docs, per_language, window)
    return predict(docs.select("doc_id", "text"), net).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
