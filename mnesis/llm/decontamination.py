"""Operator 6: benchmark decontamination by latent semantic retrieval, then longest common subsequences and answer checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnesis.llm.common import Scratch, byte_slices, release, text_buffer, token_hashes, tree_sum

def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, first token of each document (n + 1), and codes: 0 for tokens that no item has, else 1 + the term's number."""
    first = np.frombuffer(row["first"], np.int64)
    codes = np.frombuffer(pa.Codec("zstd").decompress(row["codes"], int(first[-1]) * 4), np.int32)
    return np.frombuffer(row["ids"], np.int64), first, codes


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
        release()


def passages(first: np.ndarray, codes: np.ndarray, size: int, told: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive pieces of `size` tokens of each document: piece and term of each known token (that `told` has), first piece of each document (n + 1), first token of each piece."""
    n = -(-np.diff(first) // size)
    start = np.concatenate([[0], np.cumsum(n)])
    at = np.flatnonzero(codes if told is None else told[codes])
    doc = np.searchsorted(first, at, "right") - 1
    piece = start[doc] + (at - first[doc]) // size
    begin = np.repeat(first[:-1], n) + (np.arange(start[-1]) - np.repeat(start[:-1], n)) * size
    return piece, codes[at] - 1, start, begin


def weighted(piece: np.ndarray, term: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF entries (piece, term, weight), each piece's weights having length one."""
    key, tf = np.unique(piece * len(idf) + term, return_counts=True)
    p, t = key // len(idf), key % len(idf)
    w = (1 + np.log(tf)) * idf[t]
    norm = np.sqrt(np.bincount(p, w * w, p[-1] + 1 if len(p) else 0))
    return p, t, w / np.maximum(norm[p], 1e-12)


def add_rows(out: np.ndarray, key: np.ndarray, table: np.ndarray, col: np.ndarray, scale: np.ndarray | None = None, step: int = 2048) -> None:
    """out[key] += table[col] * scale, keys being sorted: in turn the first row of each key, the second and so on, so that no step has a key twice."""
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
    size, r = np.diff(np.append(head, len(key))), 0
    while len(head):
        for lo in range(0, len(head), step):
            at = head[lo : lo + step] + r
            out[key[at]] += table[col[at]] if scale is None else table[col[at]] * scale[at]
        r += 1
        more = size > r
        head, size = head[more], size[more]


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        if m := where.get(y):
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def widths(lengths: np.ndarray, piece: int) -> np.ndarray:
    """Pieces of the windows for items of these lengths: wherever an item begins, some window of them holds all of it. Beyond 8 pieces, rounded up to eighths."""
    k = np.maximum(1, -(-(lengths - 1) // piece) + 1)
    step = 1 << np.maximum(0, np.floor(np.log2(k)).astype(np.int64) - 3)
    return -(-k // step) * step


def reaches(table: np.ndarray, item_codes: list[np.ndarray], wanted: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """How far in each item's direction a window must reach: half of what the `needed` tokens that tell least of the item come to, as the other half may lie around it."""
    return np.array([0.5 * np.sort(np.maximum(0, table[c] @ wanted[i]))[: needed[i]].sum() for i, c in enumerate(item_codes)], np.float32)


class Shares:
    """How many of an item's tokens a stretch of codes can hold in order at most: for each term, the lesser of its numbers in both."""

    def __init__(self, items: list[np.ndarray], terms: int, dense: int = 1 << 26):
        own = [np.unique(c, return_counts=True) for c in items]
        self.items, self.width = len(items), 1 + max((len(c) for c, _ in own), default=0)
        self.times = np.zeros((self.items, self.width), np.int64)
        for i, (_, n) in enumerate(own):
            self.times[i, 1 : len(n) + 1] = n
        # the number of a term within an item, 0 for terms that it lacks: a matrix where that is small, else pairs to be searched
        kind = np.uint16 if self.width <= 1 << 16 else np.uint32
        self.matrix = self.pairs = None
        if (terms + 1) * self.items <= dense:
            self.matrix = np.zeros((terms + 1, self.items), kind)
            for i, (c, _) in enumerate(own):
                self.matrix[c, i] = np.arange(1, len(c) + 1)
        else:
            pairs = np.concatenate([c.astype(np.int64) * self.items + i for i, (c, _) in enumerate(own)])
            order = np.argsort(pairs)
            self.pairs, self.number = pairs[order], np.concatenate([np.arange(1, len(c) + 1) for c, _ in own])[order]

    def local(self, codes: np.ndarray, item: np.ndarray) -> np.ndarray:
        if self.matrix is not None:
            return self.matrix[codes, item]
        key = codes.astype(np.int64) * self.items + item
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.number[at], 0)

    def has(self, codes: np.ndarray, item: int) -> np.ndarray:
        return self.local(codes, np.full(len(codes), item)) > 0

    def bounds(self, codes: np.ndarray, a: np.ndarray, b: np.ndarray, item: np.ndarray, step: int = 1 << 18) -> np.ndarray:
        """The bound for each stretch [a, b) and its item; about `step` codes or counters at a time."""
        out = np.zeros(len(a), np.int64)
        size = b - a
        upto = np.cumsum(np.maximum(size, self.width))
        lo = 0
        while lo < len(a):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + step, "right")))
            n = size[lo:hi]
            place = np.repeat(a[lo:hi] - np.cumsum(n) + n, n) + np.arange(n.sum())
            which = np.repeat(np.arange(hi - lo), n)
            local = self.local(codes[place], item[lo:hi][which])
            seen = np.flatnonzero(local)
            counts = np.bincount(which[seen] * self.width + local[seen], minlength=(hi - lo) * self.width).reshape(hi - lo, self.width)
            out[lo:hi] = np.minimum(counts, self.times[item[lo:hi]]).sum(1)
            lo = hi
        return out


def latent_terms(coded: DataFrame, idf: np.ndarray, rank: int, size: int, seed: int = 0, extra: int = 16) -> np.ndarray:
    """The right singular vectors (terms x rank) of the TF-IDF passages A, by a distributed randomised SVD in one pass.

    Tasks add up A'(A S) for a random basis S of rank + extra columns, and only such sums are moved; Nystrom's formula gives the leading eigenvectors of A'A from it.
    """
    terms = len(idf)
    wide, told = min(terms, rank + extra), np.concatenate([[False], idf > 0])
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(terms, wide)))[0]
    left = basis.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((terms, wide))
        for row in _rows(batches):
            _, first, codes = _unpack(row)
            piece, term, _, _ = passages(first, codes, size, told)
            p, t, w = weighted(piece, term, idf)
            w = w.astype(np.float32)[:, None]
            if not len(p):
                continue
            number = np.cumsum(np.concatenate([[0], p[1:] != p[:-1]]))
            y = np.zeros((number[-1] + 1, wide), np.float32)
            add_rows(y, number, left, t, w)  # A S, by passage
            order = np.argsort(t, kind="stable")
            ts, of, w = t[order], number[order], w[order]
            edge = np.append(np.flatnonzero(np.concatenate([[True], ts[1:] != ts[:-1]])), len(ts))
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                total[ts[lo]] += w[lo:hi, 0] @ y[of[lo:hi]]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    image = tree_sum(coded.mapInArrow(run, "part binary"), terms * wide).reshape(terms, wide)
    shift = 1e-9 * max(1e-30, float(np.linalg.norm(image)))
    image += shift * basis
    core = basis.T @ image
    value, vector = np.linalg.eigh((core + core.T) / 2)
    real = value > 1e-12 * max(1e-300, float(value[-1]))  # what rounding leaves of directions that no passage has
    if not real.any():
        return basis[:, :rank]
    return np.linalg.svd(image @ (vector[:, real] / np.sqrt(value[real])), full_matrices=False)[0][:, :rank]


def find_leaks(docs: DataFrame, benchmark: DataFrame, rank: int = 128, piece: int = 8, cosine: float = 0.4, common: float = 0.05, coverage: float = 0.6, answer: float = 0.5, item_block: int = 5000) -> DataFrame:
    """doc_id, item_id, coverage (of the item's tokens, in order), answer (share of its answer's tokens found) and cosine, for each document that holds an item.

    benchmark: item_id, text and perhaps answer; without that column, an item's answer is its last sentence (a line or what follows . ! or ?). Tokens are
    lower-cased (A-Z) and split at white space and ASCII punctuation; items with no token, and null texts, are in no document and hold none.

    Method: documents become codes of the items' terms, once. Their passages (8 pieces of `piece` tokens) have TF-IDF weights, with document frequencies
    counted over all of them, and a randomised SVD of these gives the latent terms; terms in over a share `common` of the passages tell nothing and are left
    out there (an item keeps its five rarest at least). An item is compared with windows of its own length, rounded up to pieces, from each piece on (see widths()).
    Those whose cosine to it is at least `cosine`, and which reach far enough in its direction (see reaches()), are candidates; the item's longest common
    subsequence with the window and its surroundings must cover `coverage` of it, and `answer` of the answer's tokens must be among it. The best window of
    each document and item is returned.

    Rows with one doc_id are taken as one document's parts; a null doc_id stays null. Repeated item_ids are items each, the best counts. Extra columns are
    ignored. Scale: one pass over texts; then codes, a few bits for each word. The stated items go against all rows in blocks of item_block, which bounds
    what tasks are sent (terms x rank numbers); each block of items is a job of its own.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontamination")
    schema = "doc_id long, item_id long, coverage double, answer double, cosine double"
    last = F.regexp_extract("text", r"([^.!?\n]*[^.!?\s][^.!?\n]*)[.!?\s]*$", 1)
    own = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long"), "text", F.coalesce(own, last).alias("answer")).where("item_id IS NOT NULL AND text IS NOT NULL")
    blocks = max(1, -(-items.count() // item_block))
    out = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        part = _block(docs, sorted(rows, key=lambda r: (r.item_id, r.text)), scratch, f"items-{b}", schema, rank, piece, cosine, common, coverage, answer)
        out = part if out is None else out.unionByName(part)
    return out


def _block(docs: DataFrame, rows: list, scratch: Scratch, label: str, schema: str, rank: int, piece: int, cosine: float, common: float, coverage: float, answer: float) -> DataFrame:
    tokens, first = token_hashes(*text_buffer(pa.array([r.text for r in rows], pa.string())))
    solution, begin = token_hashes(*text_buffer(pa.array([r.answer or "" for r in rows], pa.string())))
    vocabulary = np.unique(np.concatenate([tokens, solution])) if len(tokens) else tokens
    if not len(vocabulary):
        return docs.sparkSession.createDataFrame([], schema)
    number = lambda x: np.searchsorted(vocabulary, x).clip(0, len(vocabulary) - 1)
    codes_of = lambda x: np.where(vocabulary[number(x)] == x, number(x) + 1, 0).astype(np.int32)
    item_codes = [codes_of(tokens[first[i] : first[i + 1]]) for i in range(len(rows))]
    answers = [set(codes_of(solution[begin[i] : begin[i + 1]]).tolist()) - {0} for i in range(len(rows))]
    ids = [r.item_id for r in rows]
    terms, size = len(vocabulary), 8 * piece

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the code of the one term of a slot; where terms share a slot, they are searched for
        slot = (vocabulary & np.uint64(0xFFFFF)).astype(np.int64)
        code = np.zeros(1 << 20, np.int32)
        code[slot] = np.arange(1, terms + 1)
        crowded = np.bincount(slot, minlength=1 << 20) > 1
        held = np.concatenate([np.zeros(1, np.uint64), vocabulary])
        for batch in batches:
            for part in byte_slices(batch, "text"):
                tokens, first = token_hashes(*text_buffer(part.column("text")))
                place = (tokens & np.uint64(0xFFFFF)).astype(np.int64)
                codes = code[place]
                at = np.flatnonzero(codes)
                codes[at[held[codes[at]] != tokens[at]]] = 0
                at = np.flatnonzero(crowded[place])
                codes[at] = codes_of(tokens[at])
                p, t, start, _ = passages(first, codes, size)
                df = np.bincount(np.unique(p * terms + t) % terms, minlength=terms).astype(float)
                doc = part.column("doc_id")
                row = [doc.fill_null(0).to_numpy().tobytes(), doc.is_null().to_numpy(False).tobytes(), first.tobytes(), pa.Codec("zstd", 1).compress(codes.tobytes(), asbytes=True), np.append(df, start[-1]).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names=["ids", "nulls", "first", "codes", "part"])

    coded = scratch.save(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "ids binary, nulls binary, first binary, codes binary, part binary"), label)
    counts = tree_sum(coded, terms + 1)
    idf = np.log((counts[-1] + 1) / (counts[:-1] + 0.5)).clip(0.05)
    told = counts[:-1] <= common * counts[-1]
    for c in item_codes:
        own = np.unique(c) - 1
        told[own[np.argsort(counts[own], kind="stable")[:5]]] = True
    idf[~told] = 0
    latent = latent_terms(coded.select("first", "codes", "ids"), idf, min(rank, terms), size)
    table = np.concatenate([np.zeros((1, latent.shape[1])), latent * idf[:, None]]).astype(np.float32)  # row 0: tokens that no item has
    known = np.concatenate([[False], idf > 0])
    wanted = np.array([table[c].sum(0) for c in item_codes])
    wanted = (wanted / np.maximum(np.linalg.norm(wanted, axis=1), 1e-12)[:, None]).astype(np.float32)
    lengths = np.array([len(c) for c in item_codes])
    needed = np.maximum(1, np.ceil(coverage * lengths - 1e-9)).astype(np.int64)
    reach = reaches(table, item_codes, wanted, needed)
    wide = widths(lengths, piece)
    of_width = [(int(k), np.flatnonzero(wide == k)) for k in np.unique(wide[lengths > 0])]
    # a candidate's surroundings: an item's length on both sides, and as much more as makes it 64 tokens and two items long
    around = lengths + np.maximum(0, size - wide * piece) // 2
    shares = Shares(item_codes, terms)
    untold = np.array([(~known[c]).sum() for c in item_codes])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = [c.tolist() for c in item_codes]
        goals = [np.ascontiguousarray(wanted[which].T) for _, which in of_width]
        most = of_width[-1][0]
        for row in _rows(batches):
            doc, first, codes = _unpack(row)
            null = np.frombuffer(row["nulls"], bool)
            p, t, start, begin = passages(first, codes, piece, known)
            if not len(p):
                continue
            total = np.zeros((start[-1] + most, table.shape[1]), np.float32)
            add_rows(total, p, table, t + 1)
            of = np.repeat(np.arange(len(doc)), np.diff(start))
            stop = start[1:][of]
            tells = known[codes]
            telling, before = codes[tells], np.concatenate([[0], np.cumsum(tells)])
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            for lo in range(0, start[-1], 2048):
                at = np.arange(lo, min(lo + 2048, start[-1]))
                sums, held = np.zeros((len(at), table.shape[1]), np.float32), 0
                for (k, which), goal in zip(of_width, goals, strict=True):  # windows of k pieces from each piece on; those at a document's end hold fewer
                    if k - held <= 16:
                        for step in range(held, k):
                            over = np.flatnonzero(at + step >= stop[at])
                            kept = sums[over]
                            sums += total[lo + step : lo + step + len(at)]
                            sums[over] = kept
                    else:
                        upto = np.concatenate([np.zeros((1, table.shape[1])), np.cumsum(total[lo : at[-1] + k + 1], 0, np.float64)])
                        sums = (upto[np.minimum(at + k, stop[at]) - lo] - upto[: len(at)]).astype(np.float32)
                    held = k
                    norm = np.sqrt(np.einsum("ij,ij->i", sums, sums))
                    near = sums @ goal
                    w, i = np.nonzero(near >= np.maximum(cosine * np.maximum(norm, 1e-6)[:, None], reach[which]))
                    if not len(w):
                        continue
                    like, w, i = near[w, i] / norm[w], lo + w, which[i]
                    a = np.maximum(first[of[w]], begin[w] - around[i])
                    b = np.minimum(first[of[w] + 1], begin[w] + k * piece + around[i])
                    # a bound by the terms that tell something, which are few, and then one by all terms
                    hold = np.flatnonzero(shares.bounds(telling, before[a], before[b], i) + untold[i] >= needed[i])
                    like, w, i, a, b = like[hold], w[hold], i[hold], a[hold], b[hold]
                    most_of = shares.bounds(codes, a, b, i)
                    for j in np.flatnonzero(most_of >= needed[i]).tolist():
                        key, x = (int(of[w[j]]), int(i[j])), int(i[j])
                        if key in best and (best[key][0] >= 1 or most_of[j] < best[key][0] * lengths[x] - 0.5):
                            continue
                        region = codes[a[j] : b[j]]
                        got = lcs(plain[x], region[shares.has(region, x)].tolist()) / int(lengths[x])
                        if got >= coverage:
                            found = len(answers[x] & set(region.tolist())) / len(answers[x]) if answers[x] else 1.0
                            if found >= answer:
                                best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (got, found, float(like[j])))
            if best:
                d, i = (np.array(x) for x in zip(*best, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(doc[d], mask=null[d]), pa.array([ids[k] for k in i]), *(pa.array([float(x) for x in c]) for c in zip(*best.values(), strict=True))], names=["doc_id", "item_id", "coverage", "answer", "cosine"])

    found = coded.mapInArrow(search, schema)
    # one row for each document and item; rows of one doc_id may lie apart
    best = F.max(F.struct("coverage", "answer", "cosine"))
    return scratch.save(found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.coverage", "b.answer", "b.cosine"), f"{label}-found")
