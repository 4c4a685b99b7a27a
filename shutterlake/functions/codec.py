"""Vectors as blobs of little-endian 32-bit numbers and back. Buffers of an Arrow batch change their type; no number is copied alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def _blobs(vectors: pa.Array) -> pa.Array:
    """Null where a vector or one of its numbers is null."""
    values = vectors.flatten().cast(pa.float32())
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False))])
    bad = np.zeros(len(vectors), bool)
    if values.null_count:
        at = np.flatnonzero(pc.is_null(values).to_numpy(zero_copy_only=False))
        bad[np.searchsorted(offsets, at, side="right") - 1] = True
        values = pc.fill_null(values, 0)
    data = pa.py_buffer(np.ascontiguousarray(values.to_numpy(zero_copy_only=False), "<f4"))
    out = pa.Array.from_buffers(pa.large_binary(), len(vectors), [None, pa.py_buffer(offsets * 4), data])
    return pc.if_else(pc.or_(pc.is_null(vectors), pa.array(bad)), pa.scalar(None, pa.large_binary()), out).cast(pa.binary())


def _vectors(blobs: pa.Array) -> pa.Array:
    """Null where a blob is null or its length no multiple of 4."""
    good = pc.fill_null(pc.equal(pc.bit_wise_and(pc.binary_length(blobs), 3), 0), False)
    own = pc.if_else(good, blobs, pa.scalar(b"", blobs.type)).cast(pa.large_binary())  # so that all numbers lie end to end
    _, offsets, data = own.buffers()
    at = np.frombuffer(offsets, np.int64)[own.offset : own.offset + len(own) + 1] if len(own) else np.zeros(1, np.int64)
    values = pa.Array.from_buffers(pa.float32(), int(at[-1] - at[0]) // 4, [None, data.slice(at[0], at[-1] - at[0]) if data is not None else pa.py_buffer(b"")])
    mask = pa.array(~good.to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(((at - at[0]) // 4).astype(np.int32)), values, mask=mask)


def _mapped(df: DataFrame, column: str, kind: str, change) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(column)
            yield pa.RecordBatch.from_arrays([change(c) if k == i else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return df.mapInArrow(task, ", ".join(f"`{c}` {kind if c == column else t}" for c, t in df.dtypes))


def encoded(df: DataFrame, column: str = "embedding") -> DataFrame:
    """``df`` with an array of numbers as a blob; null for a null array and for one with a null in it."""
    return _mapped(df, column, "binary", _blobs)


def decoded(df: DataFrame, column: str = "embedding") -> DataFrame:
    """``df`` with a blob as an array of floats; null for a null blob and for one of a length that is no multiple of 4."""
    return _mapped(df, column, "array<float>", _vectors)
