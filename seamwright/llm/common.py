"""Shared pieces: scratch tables, Arrow chunking and vectorised word hashing.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. All hashing is on UTF-8
bytes with fixed tables, so every executor and every retry computes the same values.
"""

from __future__ import annotations

import atexit
import gc
import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 1 << 20
SWEEP = 3.0
_swept = 0.0
_SEED = np.random.default_rng(20240607)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


# ---------------------------------------------------------------- scratch tables
def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where it is unset, one under /tmp on a local master and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if root is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file:///tmp/seamwright-scratch-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(root)
    return root


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared scratch folder and read it back: lineage ends there.

    Unlike an executor's cache the table survives lost executors. It is removed when the
    Python process ends; shuffle files behind it can go at once, which takes a collection on the driver (every SWEEP seconds at most).
    """
    global _swept
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/seamwright/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = df.schema
    del df
    if time.monotonic() - _swept > SWEEP:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _swept = time.monotonic()
    atexit.register(_remove, spark, path)
    out = spark.read.schema(schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove scratch tables that nothing will read again."""
    for df in tables:
        _remove(df.sparkSession, df._scratch_path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may already be closed
        pass


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Long texts: hand Python fewer rows at a time, unless the session already asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, rows)


# ---------------------------------------------------------------- text chunks
class Texts:
    """UTF-8 bytes of several texts, one after the other, with their words.

    data: uint8 bytes; at: start byte of each text (one more entry than texts);
    starts, ends: byte range of each word; first: number of the first word of each text
    (one more entry than texts).
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.at = at
        space = _SPACE[data]
        n = len(data)
        if n == 0:
            self.starts = self.ends = np.zeros(0, np.int64)
        else:
            edge = np.zeros(n + 1, bool)
            edge[at] = True
            word = ~space
            begins = word.copy()
            begins[1:] &= space[:-1] | edge[1:n]
            ends = word.copy()
            ends[:-1] &= space[1:] | edge[1:n]
            self.starts = np.flatnonzero(begins)
            self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, at)
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.at) - 1

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte range."""
        power, inverse = powers(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * power[: len(self.data)], out=self._sums[1:])
        return mix((self._sums[ends] - self._sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))

    def word_hashes(self) -> np.ndarray:
        return self.span_hashes(self.starts, self.ends)

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self)), np.diff(self.first))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and its inverse modulo 2**64, for i below n at least."""
    have = max(_POWERS, default=0)
    if have < n:
        size = max(n, CHUNK_BYTES + 1)
        p, q = np.ones(size, np.uint64), np.ones(size, np.uint64)
        p[1:], q[1:] = _P, np.uint64(pow(int(_P), -1, 2**64))
        _POWERS.clear()
        _POWERS[size] = (np.cumprod(p), np.cumprod(q))
        have = size
    return _POWERS[have]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of `size` consecutive words, whatever text they belong to; another salt gives an independent hash."""
    if salt:
        words = mix(words + np.uint64(salt))
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64)
    power, inverse = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((words ^ _Q) * power[:n], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * inverse[: n - size + 1])


def inside(first: np.ndarray, size: int) -> np.ndarray:
    """For each window of `size` words of the chunk: does it lie within one text?"""
    n = int(first[-1])
    ok = np.ones(max(0, n - size + 1), bool)
    for end in first[1:-1]:
        ok[max(0, end - size + 1) : min(end, len(ok))] = False
    return ok


def text_chunks(column: pa.Array | pa.ChunkedArray, lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(first row, row after the last, Texts) of runs of rows of about `limit` bytes; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        last = min(last, n)
        yield row, last, Texts(data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row], lower)
        row = last


def rows_of(batches: Iterable[pa.RecordBatch], name: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for batch in batches:
        yield batch, batch.column(batch.schema.get_field_index(name))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
