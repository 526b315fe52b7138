"""Operator 9: remove repeated word windows, found by recompression (naming runs and pairs in rounds)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnesis.llm.common import Scratch, byte_slices, mix64, release, shuffle_partitions, text_buffer, word_bounds, word_hashes

LAST = np.iinfo(np.int64).max  # stands for a null doc_id
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


def _join(x: np.ndarray, y: np.ndarray, salt: int) -> np.ndarray:
    return mix64((x ^ np.uint64(salt)) * _A + (y ^ (y >> np.uint64(29))) * _B)


def recompress(words: np.ndarray, first: np.ndarray, rounds: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the last round's symbols, with the span of words [a, b) that settles each.

    words: hashes; first: index of each text's first word (n + 1 entries). In a round, each maximal run of a symbol gets one name, and then each pair
    whose first symbol's name falls into the left half of the alphabet, and the second's into the right half. Names are hashes of what they stand
    for, so every task gives equal content the same name with no dictionary passed around. A span holds all words that the round's decisions looked
    at: wherever the words of the span stand, the same symbol stands there. Symbols whose span is longer than a window or leaves its text are left out.
    """
    n = len(words)
    name, s = words.copy(), np.arange(n)
    e = s + 1
    a, b = s.copy(), e.copy()
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    lo, hi = first[:-1][text], first[1:][text]
    far = np.int64(1 << 40)

    def reach(at: np.ndarray, step: int, t: np.ndarray) -> np.ndarray:
        """For each symbol, whether its neighbour is in the same text."""
        out = np.zeros(len(t), bool)
        if len(t) > 1:
            inner = t[1:] == t[:-1]
            out[1 if step < 0 else 0 : len(t) if step < 0 else len(t) - 1] = inner
        return out

    t = text
    for k in range(rounds):
        if len(name) < 2:
            break
        # runs
        same = (name[1:] == name[:-1]) & (t[1:] == t[:-1])
        if same.any():
            head = np.flatnonzero(np.concatenate([[True], ~same]))
            tail = np.concatenate([head[1:], [len(name)]]) - 1
            length = (tail - head + 1).astype(np.uint64)
            long = length > 1
            new = name[head]
            new[long] = _join(new[long], length[long], 2 * k + 1)
            s, e, a, b, t, name = s[head], e[tail], a[head], b[tail], t[head], new
        else:
            long = np.zeros(len(name), bool)
        # That a run ends, one word beside it shows, unless that is the word that the next of the run would show there: then the neighbour's span does.
        left, right = reach(name, -1, t), reach(name, 1, t)
        before, after = words[np.maximum(s - 1, 0)], words[np.minimum(e, n - 1)]
        near_a, near_b = np.minimum(a, s - 1), np.maximum(b, e + 1)
        prior, later = np.concatenate([a[:1], a[:-1]]), np.concatenate([b[1:], b[-1:]])
        na = np.where(left, np.where(long | (before == words[e - 1]), np.minimum(near_a, prior), near_a), -far)
        nb = np.where(right, np.where(long | (after == words[s]), np.maximum(near_b, later), near_b), far)
        a, b = na, nb
        # pairs
        half = mix64(name ^ np.uint64(0x5851F42D4C957F2D * (k + 1) % (1 << 64))) & np.uint64(1) == 1
        pair = np.zeros(len(name), bool)
        pair[:-1] = half[:-1] & ~half[1:] & (t[1:] == t[:-1])
        second = np.concatenate([[False], pair[:-1]])
        prior, later = np.concatenate([a[:1], a[:-1]]), np.concatenate([b[1:], b[-1:]])
        alone = ~pair & ~second
        # a left symbol alone: the one after it is no right one; a right symbol alone: the one before it is no left one
        a = np.where(alone & ~half, np.where(left, np.minimum(a, prior), -far), a)
        b = np.where(alone & half, np.where(right, np.maximum(b, later), far), b)
        at = np.flatnonzero(pair)
        name[at] = _join(name[at], name[at + 1], 2 * k + 2)
        e[at] = e[at + 1]
        a[at] = np.minimum(a[at], a[at + 1])
        b[at] = np.maximum(b[at], b[at + 1])
        keep = ~second
        name, s, e, a, b, t = name[keep], s[keep], e[keep], a[keep], b[keep], t[keep]
    ok = (b - a <= window) & (a >= lo[s]) & (b <= hi[s]) if n else np.zeros(0, bool)
    return name[ok], a[ok], b[ok]


def window_hashes(kinds: list[np.ndarray], window: int) -> list[np.ndarray]:
    """For each of some kinds of word hashes, a 64-bit hash of the `window` words from each position on; the last ones, which are no whole windows, are arbitrary."""
    out: list[np.ndarray] = []
    for salt, words in zip((11, 23), kinds, strict=True):
        power, got, done, size = words, None, 0, 1
        while size <= window:
            if window & size:
                got = power if got is None else _join(got, np.concatenate([power[done:], np.zeros(min(done, len(power)), np.uint64)]), salt + size)
                done += size
            if 2 * size <= window:
                power = _join(power, np.concatenate([power[size:], np.zeros(min(size, len(power)), np.uint64)]), 1000 * salt + size)
            size *= 2
        out.append(got)
    return out


class _Block:
    """One block of texts, and what can be told of it again in each pass."""

    def __init__(self, row: dict, window: int, rounds: int):
        self.offs = np.frombuffer(row["offs"], np.int64)
        self.ids, self.null = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["nulls"], bool)
        self.raw = np.frombuffer(pa.Codec("zstd").decompress(row["body"], int(self.offs[-1])), np.uint8)
        self.starts, self.ends, self.first = word_bounds(self.raw, self.offs)
        self.words = word_hashes(self.raw, self.starts, self.ends)
        self.window, self.rounds = window, rounds

    def symbols(self) -> None:
        name, self.a, self.b = recompress(self.words, self.first, self.rounds, self.window)
        self.names, self.which, self.times = np.unique(name, return_inverse=True, return_counts=True)

    def windows(self, repeated: np.ndarray) -> None:
        """The windows that no symbol shows to be unique; hashes and order of those that stand first in the block for their words."""
        n = len(self.words)
        single = ~(repeated | (self.times > 1))[self.which]
        text = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        edge = np.zeros(n + 1, np.int64)
        a, b = self.a[single], self.b[single]
        if len(a):
            np.add.at(edge, np.maximum(b - self.window, self.first[:-1][text[a]]), 1)
            np.add.at(edge, a + 1, -1)
        open_ = np.cumsum(edge[:n]) == 0
        open_ &= np.arange(n) + self.window <= self.first[1:][text] if n else open_
        self.at = np.flatnonzero(open_)
        kinds = [self.words, word_hashes(self.raw, self.starts, self.ends, seed=7)]
        h, c = window_hashes(kinds, self.window) if n else kinds
        h, c, doc = h[self.at], c[self.at], self.ids[text[self.at]]
        order = np.lexsort((self.at, text[self.at], doc, c, h))
        hs, cs = h[order], c[order]
        head = np.ones(len(order), bool)
        head[1:] = (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1])
        self.order, self.head = order, head
        self.hash, self.check, self.doc = hs[head], cs[head], doc[order][head]

    def removed(self, later: np.ndarray) -> np.ndarray:
        """Words that a window covers whose words start earlier too. later: for each of the block's first windows, whether another block has an earlier one."""
        out = ~self.head
        out[np.flatnonzero(self.head)] = later
        p = self.at[self.order[out]]
        edge = np.zeros(len(self.words) + 1, np.int64)
        edge[p] += 1
        np.subtract.at(edge, p + self.window, 1)
        return np.cumsum(edge[:-1]) > 0

    def kept(self, removed: np.ndarray) -> Iterator[tuple[int, int, str]]:
        """Words, removed words and digest of what is kept, by text."""
        keep = ~removed
        size = np.cumsum(np.concatenate([[0], keep]))
        ranks = size[:-1] - np.repeat(size[self.first[:-1]], np.diff(self.first)) if len(keep) else size[:-1]
        mark = np.zeros(len(self.raw) + 1, np.int8)
        mark[self.starts[keep]] += 1
        mark[self.ends[keep]] -= 1
        # each kept word but the first of its text takes along the white space before it, as a blank
        blank = self.starts[keep & (ranks > 0)] - 1
        text = self.raw.copy()
        text[blank] = 0x20
        stay = np.cumsum(mark[:-1], dtype=np.int8) > 0
        stay[blank] = True
        cut = np.concatenate([[0], np.cumsum(stay)])[self.offs]
        body = text[stay].tobytes()
        for i in range(len(self.ids)):
            f, g = self.first[i], self.first[i + 1]
            yield int(g - f), int(g - f - (size[g] - size[f])), hashlib.sha256(body[cut[i] : cut[i + 1]]).hexdigest()


def _pack(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            for part in byte_slices(batch, "text", block_bytes):
                raw, offs = text_buffer(part.column("text"))
                ids = part.column("doc_id")
                row = [number, ids.fill_null(LAST).to_numpy().tobytes(), ids.is_null().to_numpy(False).tobytes(), offs.tobytes(), codec.compress(raw.tobytes(), asbytes=True)]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["block", "ids", "nulls", "offs", "body"])
                number += 1

    return run


def _cut(names: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets (ranges of names) that some of the sorted names are in, and the bounds of each in them (one entry more). No bucket without a name costs anything."""
    of = ((names >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    return of[head].astype(np.int32), np.append(head, len(of))


def _sent(block: int, buckets: int, fields: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket in which the block has something; the first field is the sorted name."""
    bucket, cut = _cut(next(iter(fields.values())), buckets)
    parts = [pa.array([v[i:j].tobytes() for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary()) for v in fields.values()]
    return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(len(bucket), block)), *parts], names=["bucket", "block", *fields])


def _by_block(marks: DataFrame) -> DataFrame:
    """One row for each block: the bits from all buckets, in the order of those. They are as many as the block has names, however many buckets there are."""
    return marks.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "n", "bits"))), lambda x: F.struct(x["n"].alias("n"), x["bits"].alias("bits"))).alias("marks"))


def _bits(marks: list[dict] | None) -> np.ndarray:
    return np.concatenate([np.unpackbits(np.frombuffer(m["bits"], np.uint8), count=m["n"]).astype(bool) for m in marks]) if marks else np.zeros(0, bool)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
        release()


def _reduce(sent: DataFrame, fields: list[tuple[str, type]], mark) -> DataFrame:
    """For each bucket, mark(columns, block ordinal) tells a bit for each row of its packed columns; the bits go back by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            sizes = np.array([len(r[fields[0][0]]) // np.dtype(fields[0][1]).itemsize for r in held])
            columns = [np.concatenate([np.frombuffer(r[f], kind) for r in held]) for f, kind in fields]
            blocks = np.array([r["block"] for r in held], np.int64)
            got = mark(columns, np.repeat(blocks, sizes))
            bits = [np.packbits(x).tobytes() for x in np.split(got, np.cumsum(sizes)[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(np.full(len(held), bucket, np.int32)), pa.array(sizes.astype(np.int32)), pa.array(bits, pa.binary())], names=["block", "bucket", "n", "bits"])

        bucket, held = None, []
        for row in _rows(batches):
            if row["bucket"] != bucket:
                yield from close()
                bucket, held = row["bucket"], []
            held.append(row)
        yield from close()

    return sent.repartition(shuffle_partitions(sent.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(run, "block long, bucket int, n int, bits binary")


def _shared(columns: list[np.ndarray], block: np.ndarray) -> np.ndarray:
    """Names that more than one block has; a block sends each of its names once."""
    (name,) = columns
    order = np.argsort(name, kind="stable")
    s = name[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(name), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _later(columns: list[np.ndarray], block: np.ndarray) -> np.ndarray:
    """Windows that another block has in a smaller doc_id (of rows with one doc_id, in an earlier block)."""
    h, c, doc = columns
    order = np.lexsort((block, doc, c, h))
    hs, cs = h[order], c[order]
    out = np.zeros(len(h), bool)
    out[order[1:]] = (hs[1:] == hs[:-1]) & (cs[1:] == cs[:-1])
    return out


def remove_repeats(docs: DataFrame, window: int = 20, rounds: int = 4, block_bytes: int = 2 << 20, bucket_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document: words that a window of `window` words covers go, if the same words also start earlier.

    Earlier is: in a smaller doc_id, or in the same document before. Rows with one doc_id count as documents in the order in which they were packed; a
    null doc_id is the largest. A null or blank text has no words and the digest of nothing. An empty table gives no rows. Other columns are ignored.

    Method: texts are packed into blocks, once. (1) Recompression names the symbols of each block; names meet by range of name, and bits go back to the
    blocks: is the name elsewhere too? (2) A window that holds the whole span of a symbol without a second occurrence is unique. The rest is hashed
    (twice 64 bits, from two independent hashes of the words), and the hashes meet likewise: does another block have it in an earlier document? (3) What is covered goes. No window is lost: a
    window without such a symbol is always compared.

    Scale: packed arrays are shuffled, a few bytes for each symbol or window that is not unique, and a block sends equal ones once: a passage in a third
    of all documents is one entry of each block. Texts are shuffled as compressed blocks only to meet their bits. A bucket has about bucket_bytes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    blocks = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pack(block_bytes), "block long, ids binary, nulls binary, offs binary, body binary")
    blocks = scratch.save(blocks, "blocks")
    # compressed text has about as many bytes as the names of the last round
    total = blocks.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    buckets = max(2 * shuffle_partitions(spark), int(total // bucket_bytes))

    def send_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            x = _Block(row, window, rounds)
            x.symbols()
            yield _sent(row["block"], buckets, {"name": x.names})

    sent = blocks.mapInArrow(send_names, "bucket int, block long, name binary")
    named = scratch.save(_by_block(_reduce(sent, [("name", np.uint64)], _shared)), "named")

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            x = _Block(row, window, rounds)
            x.symbols()
            x.windows(_bits(row["marks"]))
            yield _sent(row["block"], buckets, {"hash": x.hash, "check": x.check, "doc": x.doc})

    marked = blocks.join(named, "block", "left")
    sent = marked.mapInArrow(send_windows, "bucket int, block long, hash binary, check binary, doc binary")
    again = _by_block(_reduce(sent, [("hash", np.uint64), ("check", np.uint64), ("doc", np.int64)], _later)).withColumnRenamed("marks", "later")
    again = scratch.save(again, "again")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            x = _Block(row, window, rounds)
            x.symbols()
            x.windows(_bits(row["marks"]))
            n, gone, digest = zip(*x.kept(x.removed(_bits(row["later"]))), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x.ids, mask=x.null), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    out = scratch.save(marked.join(again, "block", "left").mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string"), "out")
    scratch.drop("blocks", "named", "again")
    return out
