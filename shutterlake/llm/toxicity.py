"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features: words, pairs of neighbours, and pairs with one or two words between, hashed to BITS bits; a feature is there or not.
Every coordinate has a learning rate of its own (from its squared gradients) and an L1 threshold, so few weights stay and the
model is a small sparse table; its bound is 2 ** BITS weights. Coordinates that ``least`` of all examples have are learned (1: all).
Learning goes by rounds over shards of the examples (``linear``): each shard goes on from the round's z and n document by
document, and the next round starts from the mean change of a coordinate over the shards that met it, so a word that few shards
have is not thinned out by the others. All changes are sent, a task's as blocks of bits that tell the coordinates and of half
precision numbers with a scale for each block. Shards are dealt by a hash, so none of this depends on files or tasks.

Defined results: a null or empty text scores by the bias alone (the share of toxic rows); with no labelled rows every score is
0.5; rows repeated or without id are scored each; extra columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import Words, distinct, free_names, mixed, scratch, slices
from shutterlake.llm.linear import MAX_ROWS, by_shard, examples, sigmoid

BITS = 21
ALPHA, BETA, L1, L2 = 6.0, 1.0, 3.5, 0.0
ROUNDS = 4
#: Coordinates that fewer examples have are not learned.
LEAST = 1
BLOCKS = 16
CHANGES = 1 << 16
THRESHOLD = 0.7
SCORE = "__toxicity"


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, hashed feature) of each occurrence."""
    row, h = words.text_of, words.hashes
    rows, keys = [row], [h]
    for gap in (1, 2, 3):
        if len(h) > gap:
            inside = row[:-gap] == row[gap:]
            rows.append(row[:-gap][inside])
            keys.append(mixed(h[:-gap][inside] * np.uint64(2 * gap + 1) + h[gap:][inside]))
    return np.concatenate(rows), (np.concatenate(keys) >> np.uint64(64 - BITS)).astype(np.int64)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches, each with its texts' distinct features."""
    for batch in slices(batches):
        row, feature = features(Words(batch.column("text")))
        keys = distinct(row << BITS | feature)
        cuts = np.searchsorted(keys, np.arange(batch.num_rows + 1) << BITS)
        keys = (keys & ((1 << BITS) - 1)).astype(np.int32)
        yield batch, [keys[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def often(rows: DataFrame) -> np.ndarray:
    """Of each coordinate, whether two examples have it at least. A task sends two bits a coordinate, whatever it has read."""
    width = (1 << BITS) // BLOCKS

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(1 << BITS, bool), np.zeros(1 << BITS, bool)
        for _, docs in documents(batches):
            for own in docs:
                twice[own[once[own]]] = True
                once[own] = True
        pack = lambda x: pa.array([np.packbits(part).tobytes() for part in x.reshape(BLOCKS, width)])
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(BLOCKS), pa.int32()), "once": pack(once), "twice": pack(twice)})

    def met(group: pa.Table) -> pa.Table:
        once = twice = np.zeros(width // 8, np.uint8)
        for a, b in zip(group.column("once").to_pylist(), group.column("twice").to_pylist(), strict=True):
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            once, twice = once | a, twice | b | (once & a)
        return pa.Table.from_pydict({"k": group.column("k")[:1], "twice": pa.array([twice.tobytes()])})

    out = np.zeros((BLOCKS, width), bool)
    for r in rows.mapInArrow(task, "k int, once binary, twice binary").groupBy("k").applyInArrow(met, "k int, twice binary").collect():  # BLOCKS rows
        out[r["k"]] = np.unpackbits(np.frombuffer(r["twice"], np.uint8)).astype(bool)
    return out.ravel()


def learned(docs: list[np.ndarray], labels: list[int], z: np.ndarray, n: np.ndarray, bias: float) -> None:
    """FTRL-proximal steps, document by document; changes ``z`` and ``n``."""
    for own, label in zip(docs, labels, strict=True):
        zs, ns = z[own], n[own]
        w = _weights(zs, ns)
        g = sigmoid(bias + w.sum()) - label
        new = ns + g * g
        z[own] = zs + g - (np.sqrt(new) - np.sqrt(ns)) / ALPHA * w
        n[own] = new


def _half(x: np.ndarray) -> tuple[float, bytes]:
    """Numbers in half precision, and what to multiply them with."""
    scale = float(np.abs(x).max(initial=0)) / 1_000 or 1.0
    return scale, (x / scale).astype(np.float16).tobytes()


def packed_changes(dz: np.ndarray, dn: np.ndarray, shards: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Summed changes of the coordinates and how many shards met each, block by block."""
    for k in range(len(shards) // CHANGES):
        own = slice(k * CHANGES, (k + 1) * CHANGES)
        met = shards[own] > 0
        if met.any():
            (sz, z), (sn, n) = _half(dz[own][met]), _half(dn[own][met])
            yield pa.RecordBatch.from_pylist([{"k": k, "met": np.packbits(met).tobytes(), "sz": sz, "z": z, "sn": sn, "n": n, "shards": shards[own][met].astype(np.uint16).tobytes()}], _CHANGE)


def mean_changes(group: pa.Table) -> pa.Table:
    """The mean change of each coordinate of a block over the shards that met it; 0 for coordinates that none did."""
    z, n, shards = np.zeros(CHANGES), np.zeros(CHANGES), np.zeros(CHANGES)
    for r in group.to_pylist():
        at = np.flatnonzero(np.unpackbits(np.frombuffer(r["met"], np.uint8)))
        z[at] += r["sz"] * np.frombuffer(r["z"], np.float16)
        n[at] += r["sn"] * np.frombuffer(r["n"], np.float16)
        shards[at] += np.frombuffer(r["shards"], np.uint16)
    shards = np.maximum(shards, 1)
    return pa.Table.from_pydict({"k": group.column("k")[:1], "z": pa.array([(z / shards).astype(np.float32).tobytes()]), "n": pa.array([(n / shards).astype(np.float32).tobytes()])})


_CHANGE = pa.schema([("k", pa.int32()), ("met", pa.binary()), ("sz", pa.float64()), ("z", pa.binary()), ("sn", pa.float64()), ("n", pa.binary()), ("shards", pa.binary())])


def fit(rows: DataFrame, rounds: int = ROUNDS, least: int = LEAST) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, coordinates, weights) learned from examples (shard, text, y), written. ``least`` is 1 or 2."""
    spark = rows.sparkSession
    total, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    bias = float(np.log((toxic + 0.5) / (total - toxic + 0.5)))
    z, n = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
    learn = spark.sparkContext.broadcast(np.packbits(often(rows)) if total and least > 1 else None)
    for _ in range(rounds if total else 0):
        known = np.flatnonzero(n).astype(np.int32)
        sent = spark.sparkContext.broadcast((known, z[known], n[known]))

        def task(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            at, zs, ns = sent.value
            allowed = None if learn.value is None else np.unpackbits(learn.value).astype(bool)
            z0, n0 = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
            z0[at], n0[at] = zs, ns
            z, n = z0.copy(), n0.copy()
            dz, dn, shards = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.int32)
            for _, part in by_shard(batches):
                docs, labels = [], []
                for batch, own in documents(part):
                    docs += own if allowed is None else [x[allowed[x]] for x in own]
                    labels += batch.column("y").to_pylist()
                learned(docs, labels, z, n, bias)
                met = distinct(np.concatenate(docs))
                dz[met] += z[met] - z0[met]
                dn[met] += n[met] - n0[met]
                shards[met] += 1
                z[met], n[met] = z0[met], n0[met]
            yield from packed_changes(dz, dn, shards)

        kind = "k int, met binary, sz double, z binary, sn double, n binary, shards binary"
        got = rows.mapInArrow(task, kind).groupBy("k").applyInArrow(mean_changes, "k int, z binary, n binary")
        for r in got.toLocalIterator():  # at most 2 ** BITS / CHANGES rows
            own = slice(r["k"] * CHANGES, (r["k"] + 1) * CHANGES)
            z[own] += np.frombuffer(r["z"], np.float32)
            n[own] += np.frombuffer(r["n"], np.float32)
        sent.destroy()
    learn.destroy()
    w = _weights(z, n).astype(np.float32)
    at = np.flatnonzero(w).astype(np.int32)
    return bias, at, w[at]


@functools.lru_cache(maxsize=1)
def _dense(at: bytes, w: bytes) -> np.ndarray:
    out = np.zeros(1 << BITS, np.float32)
    out[np.frombuffer(at, np.int32)] = np.frombuffer(w, np.float32)
    return out


def scored(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray]) -> DataFrame:
    """``docs`` with the probability that a text is toxic as last column: SCORE, or a like name that is free; all columns stay."""
    bias, at, w = model
    sent = docs.sparkSession.sparkContext.broadcast((bias, at.tobytes(), w.tobytes()))
    (name,) = free_names(docs, SCORE)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, *sparse = sent.value
        dense = _dense(*sparse)
        for batch in slices(batches):
            row, feature = features(Words(batch.column("text")))
            known = np.flatnonzero(dense[feature])
            keys = distinct(row[known] << BITS | feature[known])
            sums = np.bincount(keys >> BITS, dense[keys & ((1 << BITS) - 1)], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigmoid(bias + sums))], names=[*batch.schema.names, name])

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(task, f"{kinds}, `{name}` double")


def trained(docs: DataFrame, labels: DataFrame, allowed: Column, bound: int = MAX_ROWS) -> tuple[float, np.ndarray, np.ndarray]:
    with scratch(examples(docs, labels, "toxic", allowed, bound)) as rows:
        return fit(rows)
