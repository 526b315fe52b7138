"""Shared helpers: scratch tables in the cluster's shared folder and numpy kernels over Arrow text buffers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A word of the operators' contracts: a run of bytes outside these six.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True

_LIBC = ctypes.CDLL(None)
_OPEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, a local one of our own if all runs on this machine, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='mnesis-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete by Hadoop's file systems, so that any store that Spark writes works."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    for spark, path in _OPEN:
        try:
            if spark.sparkContext._jsc is not None:
                delete_path(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            return


def bound_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Batches that go to Python hold about `most` bytes, a row at least: by default they may have eight times as many, on both sides of every worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= most:
        spark.conf.set(key, str(most))


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is run meanwhile deletes its shuffle files as it ends: else they stay until the driver happens to collect its garbage, those of all steps at once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Scratch:
    """Intermediate tables of one run, written as Parquet to the shared folder: they cut the lineage, and a lost executor loses none of them.

    They go when drop() or keep() is called or when the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        self.spark, self.base, self.labels = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", set()
        _OPEN.append((spark, self.base))

    def path(self, label: str) -> str:
        return f"{self.base}/{label}"

    def save(self, df: DataFrame, label: str) -> DataFrame:
        with freed_shuffles(self.spark):
            df.write.mode("overwrite").parquet(self.path(label))
        self.labels.add(label)
        return self.spark.read.schema(df.schema).parquet(self.path(label))

    def drop(self, *labels: str) -> None:
        for x in labels:
            delete_path(self.spark, self.path(x))
            self.labels.discard(x)

    def keep(self, *labels: str) -> None:
        """Drop all tables but these: what a result is read from."""
        self.drop(*(self.labels - set(labels)))


def free_name(name: str, taken: Iterable[str]) -> str:
    """The name, with as many underscores as it needs to be none of those taken (in either case)."""
    held = {x.lower() for x in taken}
    while name.lower() in held:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string or binary array without copying, and its n + 1 offsets. A null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def release() -> None:
    """Give freed memory back to the system: workers live on, and what they keep adds up in an executor's limit."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def byte_slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch of about most bytes of the column, one row at least each: temporaries stay small whatever the texts' lengths."""
    if not batch.num_rows:
        return
    _, offs = text_buffer(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    release()


def word_bounds(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (bytes) of each word of the texts, and the index of the first word of each text (n + 1 entries)."""
    if not raw.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    ink = ~_IS_SPACE[raw]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    edges = offs[:-1][np.diff(offs) > 0]
    first[edges] = ink[edges]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    ends = offs[1:][np.diff(offs) > 0] - 1
    last[ends] = ink[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_R = 0x9E3779B97F4A7C15 | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64; works in place."""
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


_PIECE = 64  # bytes of a word that have a table of their own each
_WORDS = 1 << 13
_TABLES: dict[int, np.ndarray] = {}


def _tables(seed: int) -> np.ndarray:
    """A random number for each byte value at each place of a piece."""
    if seed not in _TABLES:
        _TABLES[seed] = mix64(np.arange(1, 256 * _PIECE + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + mix64(np.array([seed + 1], np.uint64)))
    return _TABLES[seed]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, without a loop over words: tabulation hashing, the sum of a random number for each byte at its place.

    Longer words are cut into pieces; their sums are mixed by a function that is not linear, with the piece's number, and added. There is no polynomial, whose
    collisions modulo a power of two hold for any base. Hashes of two seeds are independent of each other.
    """
    table, out = _tables(seed), np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), _WORDS):  # temporaries stay in the processor's cache
        out[i : i + _WORDS] = _hashed(table, raw, starts[i : i + _WORDS], ends[i : i + _WORDS])
    return out


def _hashed(table: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = (ends - starts).astype(np.int64)
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum()), dtype=np.int64)
    at = raw[place + np.repeat(starts - first, size)]
    place -= np.repeat(first, size)
    values = table.take(((place & (_PIECE - 1)) << 8) | at)
    if size.max() <= _PIECE:
        return mix64(mix64(np.add.reduceat(values, first)) + size.astype(np.uint64) * np.uint64(_R))
    head = np.flatnonzero((place & (_PIECE - 1)) == 0)
    pieces = mix64(np.add.reduceat(values, head) + (place[head] // _PIECE).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return mix64(np.add.reduceat(pieces, np.searchsorted(head, first)) + size.astype(np.uint64) * np.uint64(_R))


_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = [ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(128)]


def token_hashes(raw: np.ndarray, offs: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' tokens (A-Z lower-cased, ASCII punctuation as white space), and the index of each text's first (n + 1 entries).

    With prefixes, those of longer tokens that have so many bytes follow each text's tokens, as hashes of their own kind.
    """
    plain = _PLAIN[raw]
    starts, ends, first = word_bounds(plain, offs)
    whole = word_hashes(plain, starts, ends, seed=1)
    if not prefixes or not len(whole):
        return whole, first
    parts, texts = [whole], [np.searchsorted(first, np.arange(len(whole)), "right") - 1]
    for k in prefixes:
        long = ends - starts > k
        parts.append(word_hashes(plain, starts[long], starts[long] + k, seed=1) ^ np.uint64(k))
        texts.append(texts[0][long])
    text = np.concatenate(texts)
    return np.concatenate(parts)[np.argsort(text, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(first) - 1))])


def tree_sum(parts: DataFrame, width: int, kind: str = "float64", fan: int = 16, add: np.ufunc = np.add) -> np.ndarray:
    """The sum of packed arrays (column part: bytes of `width` numbers): added in each task, then of `fan` tasks each in one, until one array is left for the driver."""

    def run(batches):
        total = None
        for batch in batches:
            for x in batch.column(0):
                a = np.frombuffer(x.as_buffer(), kind)
                total = a.copy() if total is None else add(total, a, out=total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    tasks = parts.rdd.getNumPartitions()
    each = parts.select("part").mapInArrow(run, "part binary")
    while tasks > 1:
        tasks = -(-tasks // fan)
        each = each.repartition(tasks).mapInArrow(run, "part binary")
    rows = each.collect()  # one at most
    return np.frombuffer(rows[0].part, kind).copy() if rows else np.zeros(width, kind)
