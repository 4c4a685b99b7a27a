"""Language-model scores from a log-frequency Bloom filter of words and word pairs.

A count is kept as its level on a scale of powers of BASE; the filter holds (n-gram, 1), ..., (n-gram, level), so a level is
found by membership probes: the first level, then a binary search, as all lower levels of a member are members too. The filter
is built in Spark: each task of the first pass counts its own n-grams and deals them to hash buckets; a bucket's counts are
added up in one task, which makes that bucket's part of the filter. The number of buckets grows with the text, a bucket does
not. All words and word pairs are in, those that occur once at level 1.

P(w|h) = a(h) low(c(h,w)) / up(c(h)) + (1 - a(h)) P(w), with low and up the ends of a level, so that no history gives away more
than it has; a(h) = WEIGHT up / (up + MIX). P(w) is (q + 1) / (Z + V + 1) with q a level's middle and Z the sum of q over all words.

The filter goes to the workers in parts of MAX_BROADCAST bytes at most. One part is the usual case; of more, each gets a pass
over the texts that notes what levels it knows (``annotated``), and the notes are scored at the end.

``base`` needs exact counts: words whose level is so high that at most HEAD words reach it are broadcast as a table; the other
words of each document go through a join with all counts.

Defined results: a null or empty text is its end token alone; documents repeated or without id are scored (and learned from)
each; with nothing to learn from every token is unknown and N = V = 0; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import Words, batches_of, mixed, slices, written

BASE = 1.5
WEIGHT, MIX = 0.45, 30.0
BITS_AN_ENTRY, PROBES = 12, 6
BUCKET_BYTES = 16 << 20
PIECE = 1 << 18
TOKENS_A_FLUSH = 1_000_000
HEAD = 1 << 20
MAX_BROADCAST = 256 << 20
_U = np.uint64
END, BEGIN = mixed(np.array([101, 102], np.uint64))
_WORD, _PAIR = 0, 1
#: Smallest count of each level from 1 on.
FLOORS = np.unique(np.ceil(BASE ** np.arange(100)).astype(np.int64))
_LOW = np.concatenate([[0], FLOORS[:-1]]).astype(float)
_UP = np.concatenate([[0], FLOORS[1:] - 1]).astype(float)
_MIDDLE = np.concatenate([[0.0], np.sqrt(_LOW[1:] * _UP[1:])])


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(FLOORS, counts, side="right")


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and ends in order, hashes of pairs that end there, and each text's first (one more than texts)."""
    words = Words(texts)
    n = len(words.first) - 1
    first = words.first + np.arange(n + 1)
    h = np.full(first[-1], END, np.uint64)
    h[np.arange(len(words.hashes)) + words.text_of] = words.hashes
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[first[:-1]] = BEGIN
    return h, mixed(before * _U(3) + h + _U(7)), first


# ---- the filter


def _places(keys: np.ndarray, lev: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    a = mixed(keys + lev.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    b = (a >> _U(32)) | _U(1)
    for i in range(PROBES):
        yield ((a + _U(i) * b) * _U(0xD6E8FEB86659FD93) >> _U(20)) % _U(bits)


def built(keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The bits of a bucket that holds each key at its levels."""
    bits = max(64, int(levels.sum()) * BITS_AN_ENTRY // 64 * 64 + 64)
    flags = np.zeros(bits, bool)
    for a in range(0, len(keys), PIECE):
        own, high = keys[a : a + PIECE], levels[a : a + PIECE]
        for lev in range(1, int(high.max(initial=0)) + 1):
            own, high = own[high >= lev], high[high >= lev]
            for place in _places(own, np.full(len(own), lev), bits):
                flags[place] = True
    return np.packbits(flags, bitorder="little")


class Filter:
    """Some buckets of the filter: their bits end to end. ``held``: which of all buckets these are, by their offset; -1: not here."""

    def __init__(self, buckets: int, parts: Iterable[tuple[int, bytes]], size: int):
        self.offset, self.bits = np.full(2 * buckets, -1, np.int64), np.zeros(2 * buckets, np.uint64)
        self.buckets, self.data, at = buckets, np.zeros(max(size, 1), np.uint8), 0
        for k, blob in parts:
            self.offset[k], self.bits[k] = at, len(blob) * 8
            self.data[at : at + len(blob)] = np.frombuffer(blob, np.uint8)
            at += len(blob)

    def _member(self, keys: np.ndarray, lev: np.ndarray, at: np.ndarray, bits: np.ndarray) -> np.ndarray:
        a = mixed(keys + lev.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
        b = (a >> _U(32)) | _U(1)
        yes = np.arange(len(keys))
        for i in range(PROBES):
            place = ((a[yes] + _U(i) * b[yes]) * _U(0xD6E8FEB86659FD93) >> _U(20)) % bits[yes]
            hit = self.data[at[yes] + (place >> _U(3)).astype(np.int64)] >> (place & _U(7)).astype(np.uint8) & 1
            yes = yes[hit.astype(bool)]
        out = np.zeros(len(keys), bool)
        out[yes] = True
        return out

    def levels(self, keys: np.ndarray, kind: int, most: int) -> np.ndarray:
        """The level of each key: 0 for those not in the filter or of buckets that are not here."""
        bucket = bucket_of(keys, self.buckets) + kind * self.buckets
        out = np.zeros(len(keys), np.uint8)
        here = np.flatnonzero(self.offset[bucket] >= 0)
        key = stored(keys[here]) if kind == _PAIR else keys[here]
        at, bits = self.offset[bucket[here]], self.bits[bucket[here]]
        one = self._member(key, np.ones(len(key), np.int64), at, bits)
        here, key, at, bits = here[one], key[one], at[one], bits[one]
        low, high = np.ones(len(key), np.int64), np.full(len(key), most, np.int64)
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_] + 1) // 2
            yes = self._member(key[open_], middle, at[open_], bits[open_])
            low[open_[yes]] = middle[yes]
            high[open_[~yes]] = middle[~yes] - 1
        out[here] = low
        return out


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Of a power of two buckets, by the key's first bits."""
    return (keys >> _U(40) & _U(buckets - 1)).astype(np.int64)


def stored(keys: np.ndarray) -> np.ndarray:
    """What of a pair's hash is kept: the lower 48 bits; of many buckets, the number of its own tells it from others besides."""
    return keys & _U((1 << 48) - 1)


# ---- counting


def _dealt(keys: list[np.ndarray], kind: int, buckets: int) -> Iterator[dict]:
    distinct, n = np.unique(np.concatenate(keys), return_counts=True)
    bucket = bucket_of(distinct, buckets)
    order = np.argsort(bucket, kind="stable")
    met, cuts = np.unique(bucket[order], return_index=True)  # only buckets that have keys here, however many there are
    for k, own in zip(met.tolist(), np.split(order, cuts[1:]), strict=False):
        raw = distinct[own].view(np.uint8).reshape(-1, 8)
        yield {"bucket": k + kind * buckets, "keys": (raw if kind == _WORD else raw[:, :6]).tobytes(), "counts": n[own].astype("<u4").tobytes()}


_DEALT = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_MERGED = pa.schema([("bucket", pa.int32()), ("bits", pa.binary()), ("most", pa.int32()), ("tokens", pa.int64()), ("distinct", pa.int64()), ("middles", pa.float64()), ("words", pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64())])))])


def counted(docs: DataFrame, buckets: int) -> DataFrame:
    """A row for each bucket: its part of the filter, sums, and the exact counts of its words."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, n = [], [], 0

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([*_dealt(words, _WORD, buckets), *_dealt(pairs, _PAIR, buckets)], schema=_DEALT)

        for batch in slices(batches):
            h, p, _ = tokens(batch.column("text"))
            words.append(h)
            pairs.append(p)
            n += len(h)
            if n >= TOKENS_A_FLUSH:
                yield flushed()
                words, pairs, n = [], [], 0
        if n:
            yield flushed()

    def merge(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        pair = bucket >= buckets
        rows = sum(len(x.as_buffer()) for x in group.column("counts")) // 4
        keys, n, at = np.zeros(rows, np.uint64), np.zeros(rows, np.int64), 0
        for k, c in zip(group.column("keys"), group.column("counts"), strict=True):
            c = np.frombuffer(c.as_buffer(), "<u4")
            n[at : at + len(c)] = c
            keys[at : at + len(c)].view(np.uint8).reshape(-1, 8)[:, : 6 if pair else 8] = np.frombuffer(k.as_buffer(), np.uint8).reshape(len(c), -1)
            at += len(c)
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        del order
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, n = keys[starts], np.add.reduceat(n, starts)
        lev = level(n).astype(np.uint8)
        row = {"bucket": [bucket], "bits": [built(keys, lev).tobytes()], "most": [int(lev.max(initial=0))], "tokens": [int(n.sum())], "distinct": [len(n)], "middles": [float(_MIDDLE[lev].sum())]}
        words = pa.StructArray.from_arrays([pa.array(x[: 0 if pair else None]) for x in (keys.view(np.int64), n)], names=["h", "c"])
        return pa.Table.from_pydict(row | {"words": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)}, schema=_MERGED)

    kinds = "bucket int, bits binary, most int, tokens bigint, distinct bigint, middles double, words array<struct<h: bigint, c: bigint>>"
    return docs.select("text").mapInArrow(deal, "bucket int, keys binary, counts binary").groupBy("bucket").applyInArrow(merge, kinds)


class Model:
    """What scoring needs on the workers besides the filter: sums, and the base scores of frequent words."""

    def __init__(self, total: int, distinct: int, middles: float, documents: int, most: tuple[int, int], heads: np.ndarray, counts: np.ndarray):
        self.total, self.distinct, self.most, self.heads = total, distinct, most, heads
        self.bases = self.base(counts)
        self.unigram = (_MIDDLE + 1) / (middles + distinct + 1)
        self.begin = level(np.array([documents]))[0]

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.total + self.distinct + 1))

    def log10(self, word: np.ndarray, pair: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Per text, from the levels of its words and pairs."""
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[first[:-1]] = self.begin
        up = _UP[before]
        a = WEIGHT * up / (up + MIX)
        p = a * np.minimum(1.0, _LOW[pair] / np.maximum(up, 1)) + (1 - a) * self.unigram[word]
        return np.add.reduceat(np.log10(p), first[:-1]) if len(first) > 1 else np.zeros(0)


class Trained:
    """The model: (h, c) of all words as a table, the filter's parts on the driver as broadcasts, and the ``Model``."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        size, documents = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
        self.buckets = 1 << max(4, int(np.ceil(np.log2(max(1, size / BUCKET_BYTES)))))
        with batches_of(spark):
            merged = written(counted(docs, self.buckets))
        self.words = merged.select(F.explode("words").alias("w")).select("w.h", "w.c")
        sums = merged.select("bucket", "most", "tokens", "distinct", "middles", F.length("bits").alias("bytes")).collect()  # a row a bucket
        words = [r for r in sums if r["bucket"] < self.buckets]
        most = tuple(max([1, *(r["most"] for r in sums if (r["bucket"] >= self.buckets) == bool(k))]) for k in (_WORD, _PAIR))
        # frequent words: of the highest levels that hold no more than HEAD words together
        floors = F.array(*(F.lit(int(x)) for x in FLOORS))
        by = self.words.groupBy(F.size(F.filter(floors, lambda x: x <= F.col("c"))).alias("l")).agg(F.count("*").alias("n")).collect()
        lowest, held = 1 << 30, 0
        for r in sorted(by, key=lambda r: -r["l"]):
            if (held := held + r["n"]) > HEAD:
                break
            lowest = int(FLOORS[r["l"] - 1])
        head = self.words.where(F.col("c") >= lowest).toArrow()
        h, c = (head.column(k).to_numpy() for k in ("h", "c"))
        order = np.argsort(h.view(np.uint64))
        self.model = Model(sum(r["tokens"] for r in words), sum(r["distinct"] for r in words), sum(r["middles"] for r in words), documents, most, h.view(np.uint64)[order], c[order])
        # the filter in parts that may be broadcast
        self.parts, part, size = [], [], 0
        for r in sorted(sums, key=lambda r: r["bucket"]):
            if part and size + r["bytes"] > MAX_BROADCAST:
                self.parts.append(part)
                part, size = [], 0
            part.append(r["bucket"])
            size += r["bytes"]
        self.parts.append(part)
        self.merged, self.spark, self.sizes = merged, spark, {r["bucket"]: r["bytes"] for r in sums}

    def part(self, i: int) -> Filter:
        rows = self.merged.where(F.col("bucket").isin(self.parts[i])).select("bucket", "bits").toLocalIterator()
        return Filter(self.buckets, ((r["bucket"], r["bits"]) for r in rows), sum(self.sizes[k] for k in self.parts[i]))


def _levels(own: Filter, h: np.ndarray, p: np.ndarray, most: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for keys, kind in ((h, _WORD), (p, _PAIR)):
        distinct, which = np.unique(keys, return_inverse=True)
        out.append(own.levels(distinct, kind, most[kind])[which])
    return out[0], out[1]


def annotated(docs: DataFrame, sent: Broadcast[Filter], most: tuple[int, int]) -> DataFrame:
    """``docs`` with the levels of words and pairs, a byte each, that this part of the filter knows added to ``__levels``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, p, first = tokens(batch.column("text"))
            word, pair = _levels(sent.value, h, p, most)
            known = batch.column("__levels").to_pylist()
            made = []
            for k, old in enumerate(known):
                a, b = first[k], first[k + 1]
                new = np.concatenate([word[a:b], pair[a:b]])
                made.append((new | np.frombuffer(old, np.uint8) if old else new).tobytes())
            columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"__levels": pa.array(made, pa.binary())}
            yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(task, docs.schema)


_OUT = "doc_id {id}, n_tokens bigint, head_known bigint, head_base double, rest array<struct<h: bigint, n: int>>, score double"


def first_scores(docs: DataFrame, trained: Trained) -> DataFrame:
    """Per row the model's score, and the base score as far as the frequent words go; ``rest``: the other words."""
    model = trained.spark.sparkContext.broadcast(trained.model)
    one = len(trained.parts) == 1
    own = docs.select("doc_id", "text")
    if not one:
        own = own.withColumn("__levels", F.lit(None).cast("binary"))
        for i in range(len(trained.parts)):
            sent = trained.spark.sparkContext.broadcast(trained.part(i))
            with batches_of(trained.spark):
                own = written(annotated(own, sent, trained.model.most))
            sent.destroy()
    sent = trained.spark.sparkContext.broadcast(trained.part(0)) if one else None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        kind = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32())]))
        for batch in slices(batches):
            h, p, first = tokens(batch.column("text"))
            rows = len(first) - 1
            row = np.repeat(np.arange(rows), np.diff(first))
            if one:
                word, pair = _levels(sent.value, h, p, m.most)
            else:
                both = [np.frombuffer(x, np.uint8).reshape(2, -1) for x in batch.column("__levels").to_pylist()]
                word, pair = (np.concatenate([x[k] for x in both]) for k in (0, 1))
            distinct, which = np.unique(h, return_inverse=True)
            at = np.minimum(np.searchsorted(m.heads, distinct), max(len(m.heads) - 1, 0))
            found = m.heads[at] == distinct if len(m.heads) else np.zeros(len(distinct), bool)
            value = np.where(found, m.bases[at], 0.0) if len(m.heads) else np.zeros(len(distinct))
            head = found[which]
            rest = np.flatnonzero(~head)
            # the other words of a row, each with its count
            order = rest[np.lexsort((h[rest], row[rest]))]
            starts = np.flatnonzero(np.concatenate([[True], (row[order][1:] != row[order][:-1]) | (h[order][1:] != h[order][:-1])])) if len(order) else order
            times = np.diff(np.append(starts, len(order)))
            offsets = np.searchsorted(row[order][starts], np.arange(rows + 1)) if len(order) else np.zeros(rows + 1, np.int64)
            items = pa.StructArray.from_arrays([pa.array(h[order][starts].view(np.int64)), pa.array(times.astype(np.int32))], names=["h", "n"])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array(np.diff(first)),
                "head_known": pa.array(np.bincount(row[head], minlength=rows)),
                "head_base": pa.array(np.bincount(row, value[which], minlength=rows)),
                "rest": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), items).cast(kind),
                "score": pa.array(m.log10(word, pair, first)),
            })

    return own.mapInArrow(task, _OUT.format(id=docs.schema["doc_id"].dataType.simpleString()))


def scored(docs: DataFrame, trained: Trained) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``."""
    m = trained.model
    with batches_of(docs.sparkSession):
        first = written(first_scores(docs, trained).withColumn("rid", F.monotonically_increasing_id()))
    bottom = float(m.total + m.distinct + 1)
    rest = first.select("rid", F.explode("rest").alias("r")).select("rid", "r.h", "r.n")
    met = rest.join(trained.words, "h", "left").groupBy("rid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(bottom))).alias("base"))
    return first.join(met, "rid", "left").select(
        "doc_id", "n_tokens", (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(m.total).cast("bigint").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("base", F.lit(0.0))).alias("base_score"), "score")
