"""Texts of an Arrow batch as arrays of bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end and each text's first byte (one offset more than texts); null is an empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def characters(data: np.ndarray) -> np.ndarray:
    """How many characters begin before each byte (one more than bytes)."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] ... starts[i] + lengths[i] - 1 for each i, end to end."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def texts_of(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets.astype(np.int64))), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())


def parts(batch: pa.RecordBatch, column: str, size: int = 4 << 20) -> list[pa.RecordBatch]:
    """The batch in runs of rows with about ``size`` bytes of text each; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // size)) + 1).tolist(), batch.num_rows]
    return [batch.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
