"""The nearest row of a time before, in blocks of two bounded sides as matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DEALT = ("bank", "day", "dim", "part", "lot", "side", "id", "until", "since", "least", "v")
GOT = "id long, existing long, cos double"
#: A matrix product differs from a sum in order by far less than this; a cosine of 6 digits by half a digit from what it is rounded from.
SLACK = 1.1e-6
#: Rows of one side that a product takes at once.
STEP = 512


def vectors(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of one length without nulls as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def rounded(x: np.ndarray) -> np.ndarray:
    """Six digits, halves away from zero, as Spark rounds a double's decimal form: a bound of seven digits is its own decimal form."""
    a = np.abs(x)
    n = np.floor(a * 1e6 + 0.5)
    n = n - (a < (2 * n - 1) / 2e6) + (a >= (2 * n + 1) / 2e6)
    return np.copysign(n / 1e6, x)


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, each added up from its first component to its last."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out = out + a[:, k] * b[:, k]
    return out


class Side:
    """Rows of a block, each of their vectors once, so that copies cost a product once."""

    def __init__(self, v: np.ndarray):
        self.v, self.of = np.unique(v, axis=0, return_inverse=True)
        self.of = self.of.reshape(-1)
        self.odd = ~np.isfinite(self.v).all(axis=1)
        plain = np.where(self.odd[:, None], 0.0, self.v)
        self.norm = np.sqrt(in_order(plain, plain))
        self.unit = np.divide(plain, self.norm[:, None], out=np.zeros_like(plain), where=self.norm[:, None] > 0)


def cosines(a: Side, b: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of pairs of vectors; with a zero vector 0, with one that isn't finite NaN."""
    norm = a.norm[i] * b.norm[j]
    out = np.divide(in_order(a.v[i], b.v[j]), norm, out=np.zeros(len(i)), where=norm > 0)
    return np.where(a.odd[i] | b.odd[j], np.nan, out)


def best(a: Side, b: Side, fits: np.ndarray, least: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of a: which have a fitting row of b at their least cosine, that row's id (of equal cosines of 6 digits the least) and the cosine. NaN is above all."""
    near = a.unit @ b.unit.T
    near[a.odd, :] = near[:, b.odd] = np.inf
    near = np.where(fits, near[a.of][:, b.of], -np.inf)
    top = near.max(axis=1)
    row, col = np.nonzero(near >= np.maximum(np.where(np.isinf(top), top, top - SLACK), least - SLACK)[:, None])
    row, col = row[fits[row, col]], col[fits[row, col]]
    pair, back = np.unique(a.of[row] * len(b.v) + b.of[col], return_inverse=True)
    cos = rounded(cosines(a, b, pair // len(b.v), pair % len(b.v)))[back.reshape(-1)]
    reached = np.isnan(cos) | (cos >= least[row])
    row, col, cos = row[reached], col[reached], cos[reached]
    order = np.lexsort((ids[col], -np.where(np.isnan(cos), np.inf, cos), row))
    row, col, cos = row[order], col[order], cos[order]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    return row[first], ids[col[first]], cos[first]


def nearest(dealt: DataFrame, tasks: int) -> DataFrame:
    """For each row of side 1 and block (bank, day, dim, part, lot) the nearest of the block's rows of side 0 whose time `until` is after the row's `since`, not after its
    `until`, and whose id is another: id, existing, cos, if it reaches the row's least. Side 0 of a block is held, and side 1 streams by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, whole = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [batch.column(c).dictionary_encode().indices.to_numpy() if c == "bank" else batch.column(c).cast(pa.int32()).to_numpy() for c in DEALT[:6]]
            cuts = [0, *(np.flatnonzero(np.any([np.diff(x) != 0 for x in codes], axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                piece = batch.slice(lo, hi - lo)
                k = tuple(piece.column(c)[0].as_py() for c in DEALT[:5])
                if k != key:
                    key, held, whole = k, [], None
                ids, until, since = (piece.column(c).cast(pa.int64()).to_numpy() for c in ("id", "until", "since"))
                v = vectors(piece.column("v"), k[2])
                if piece.column("side")[0].as_py() == 0:
                    held.append((v, ids, until))
                    continue
                if not held:
                    continue
                if whole is None:
                    w, others, times = (np.concatenate(x) for x in zip(*held, strict=True))
                    whole, held = (Side(w), others, times), [True]
                side, others, times = whole
                least = piece.column("least").to_numpy()
                for s in range(0, len(ids), STEP):
                    cut = slice(s, s + STEP)
                    fits = (times[None, :] <= until[cut, None]) & (times[None, :] > since[cut, None]) & (others[None, :] != ids[cut, None])
                    some = np.flatnonzero(fits.any(axis=1))
                    if len(some):
                        row, other, cos = best(Side(v[cut][some]), side, fits[some], least[cut][some], others)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[cut][some][row]), pa.array(other), pa.array(cos)], names=["id", "existing", "cos"])

    blocks = DEALT[:5]
    return dealt.repartition(tasks, *blocks).sortWithinPartitions(*blocks, "side").mapInArrow(run, GOT)
