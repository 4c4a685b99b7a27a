"""What the operators of this package share: tables, the shared work folder and words as numpy arrays.

Tasks see texts as Arrow batches. ``Words`` finds the words of a whole batch at once and hashes each to 64 bits, so that the
operators count, compare and look up numbers instead of Python strings. Nothing here holds more than one slice of a batch
(``slices``; a single long text is a slice of its own).
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder path under spark.checkpoint.dir. Only a local session without that setting gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="shutterlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None, compression: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, read by all that follows, safe when executors are lost."""
    path = path or work_dir(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(df: DataFrame, compression: str = "zstd") -> Iterator[DataFrame]:
    """``written`` for as long as the block runs: what is made from the table must be computed within it."""
    spark, path = df.sparkSession, work_dir(df.sparkSession)
    try:
        yield written(df, path, compression)
    finally:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


@contextlib.contextmanager
def batches_of(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """While the block runs, rows go to Python in Arrow batches of about ``size`` bytes. Spark's own limit is 64 MB, and a batch lies in the
    memory of an executor some times over for each core: in vectors that double, in the buffer of the pipe, and in Python."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, old)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of ``df`` has, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id's decimal text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the one of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeds(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = seeds(256, 11)
_BYTE[_IS_SPACE] = 0
_FOLDED = _BYTE.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = _U(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 4096) - 1, _BASE)]))
    return _powers


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end and each text's first byte (one offset more than texts); null is an empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return raw, (at - at[0] if len(at) else np.zeros(1, np.int64))


class Words:
    r"""The words ``[^\x20\x09-\x0D]+`` of some texts, in order.

    starts, ends: bytes of each word in ``data``; first: index of each text's first word (one more than texts);
    hashes: 64 bits per word, A-Z as a-z unless ``exact``. breaks: tells, of the bytes, before which of them words end too.
    """

    def __init__(self, texts: pa.Array, exact: bool = False, breaks: Callable[[np.ndarray], np.ndarray] | None = None):
        self.data, self.offsets = utf8(texts)
        n = len(self.data)
        space = _IS_SPACE[self.data]
        begins, word = np.zeros(n + 1, bool), ~space
        if breaks:
            begins[:-1] = breaks(self.data)
        begins[self.offsets] = True
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[0], before[1:] = True, space[:-1]
            after[-1], after[:-1] = True, space[1:]
        self.starts = np.flatnonzero(word & (before | begins[:-1]))
        self.ends = np.flatnonzero(word & (after | begins[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        if len(self.starts):
            lo = self.starts[0]
            place = np.arange(lo, n) - np.repeat(self.starts, np.diff(np.append(self.starts, n)))
            place[space[lo:]] = 0
            values = (_BYTE if exact else _FOLDED)[self.data[lo:]] * _powers_to(int((self.ends - self.starts).max()) + 1)[place]
            self.hashes = mixed(np.add.reduceat(values, self.starts - lo) + (self.ends - self.starts).astype(np.uint64))
        else:
            self.hashes = np.zeros(0, np.uint64)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``size`` bytes of text and ``rows`` rows at most, so that arrays over a slice stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // size
        cuts = sorted({*range(0, batch.num_rows, rows), *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows})
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] ... starts[i] + lengths[i] - 1 for each i, end to end."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by a sort, which is many times faster here than np.unique's hashing."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x
