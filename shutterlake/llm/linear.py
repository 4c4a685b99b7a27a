"""Linear models over hashed features, trained by rounds of parameter mixing.

``dealt`` writes the rows to learn from once, dealt to shards by a hash of the row; a shard's rows are in one file, in an order
of their own. In each round every shard starts from the state that the driver sent and learns from its rows in turn; what the
shards changed is added up in Spark (``summed``) and the next state goes out. So the result depends on the shards alone, not on
how files are packed into tasks. The state's size is fixed by the model, never by the data.

``Grams`` are the inputs of the two quality models: n-grams of characters (code points, A-Z as a-z), of words, and of the kinds
of characters, and a cell for how often words repeat. A text's value is, for each of these sections, the mean of the weights of
its n-grams, and the sum over sections, so that no table of counts is made; texts of any length compare.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import Words, distinct, mixed, seeds, slices

#: The sample of labelled rows that a model learns from has about so many rows at most.
MAX_ROWS = 200_000
ROWS_A_SHARD = 2_000
MOST_FILES = 20_000
ROWS_A_SLICE = 128
BLOCK = 1_024
_U = np.uint64


def sampled(rows: DataFrame, key: Column, bound: int | None) -> DataFrame:
    """``rows``, or of more than ``bound`` about that many, chosen by a hash of ``key``; all if it is None."""
    if bound is None or (n := rows.count()) <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(key, F.lit(97)), F.lit(1_000_000)) < int(1e6 * bound / n))


def labelled(labels: DataFrame, target: str, allowed: Column, bound: int | None = MAX_ROWS) -> DataFrame:
    """(doc_id, y) of rows of ``labels`` for which ``allowed``: about ``bound`` at most.

    Of an id labelled twice the larger label counts, null labels and ids do not.
    """
    known = labels.where(allowed & F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(target).cast("int")).alias("y"))
    return sampled(known, F.col("doc_id"), bound)


def examples(docs: DataFrame, labels: DataFrame, target: str, allowed: Column, bound: int = MAX_ROWS) -> DataFrame:
    """(shard, text, y) of labelled documents, to be written. The labels are broadcast: about ``bound`` pairs of numbers at most."""
    chosen = labelled(labels, target, allowed, bound)
    return dealt(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), shards_for(chosen.count()))


def shards_for(rows: int) -> int:
    """ROWS_A_SHARD rows or so in each, four shards at least."""
    return max(4, rows // ROWS_A_SHARD)


def dealt(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` (doc_id, text, ...) with their shard instead of doc_id: by a hash, or, where they have a column ``to``, that one; spare
    rows (a column ``spare``) come first in a shard."""
    place = F.xxhash64("doc_id", "text", F.lit(3))
    hashed = rows.withColumn("shard", F.pmod(place, F.lit(shards)).cast("int"))
    if "to" in rows.columns:
        hashed = hashed.withColumn("shard", F.coalesce("to", "shard")).drop("to")
    hashed = hashed.withColumn("turn", F.xxhash64("doc_id", "text", F.lit(4)))
    first = [F.desc("spare")] if "spare" in rows.columns else []
    return hashed.drop("doc_id").repartition(min(shards, MOST_FILES), "shard").sortWithinPartitions("shard", *first, "turn").drop("turn")


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """The batches of each shard in turn; rows come shard by shard."""
    waiting: list[pa.RecordBatch] = []

    def more() -> bool:
        while not waiting:
            batch = next(batches, None)
            if batch is None:
                return False
            shard = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            waiting.extend(batch.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a)
        return True

    def own(shard: int) -> Iterator[pa.RecordBatch]:
        while more() and waiting[0].column("shard")[0].as_py() == shard:
            yield waiting.pop(0)

    while more():
        shard = waiting[0].column("shard")[0].as_py()
        part = own(shard)
        yield shard, part
        for _ in part:  # what the learner left
            pass


def summed(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], width: int) -> np.ndarray:
    """The sum over tasks of the vectors of ``width`` that ``work`` makes: a task sends blocks, Spark adds equal ones up."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = work(batches)
        if total is not None:
            for k in range(0, width, BLOCK):
                if (part := total[k : k + BLOCK]).any():
                    yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "part": pa.array([part.astype(np.float64).tobytes()], pa.binary())})

    def added(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer()) for x in group.column("part"))
        return pa.Table.from_pydict({"k": group.column("k")[:1], "part": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(width)
    for r in rows.mapInArrow(task, "k int, part binary").groupBy("k").applyInArrow(added, "k int, part binary").toLocalIterator():  # at most width / BLOCK rows
        part = np.frombuffer(r["part"])
        out[r["k"] : r["k"] + len(part)] = part
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


# ---- hashed n-grams

KIND_BITS, CHAR_BITS, WORD_BITS, REPEATS = 13, 16, 16, 32
KINDS, CHARS, WORDS = (1, 2, 3, 4, 5), (3, 4, 5), (1, 2)
_AT = np.cumsum([0, 1 << KIND_BITS, 1 << CHAR_BITS, 1 << WORD_BITS, REPEATS])
#: Weights of a model: those of the sections, and one for all texts.
WIDTH = int(_AT[-1]) + 1
_CLASS = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 1 if _b >= 0xC0 else 0 if _b >= 0x80 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c == "\n" else 5 if _c.isspace() or _b < 0x20 or _b == 0x7F else 6 + "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~".index(_c)
_KIND_VALUE = seeds(64, 21)
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[ord("A") : ord("Z") + 1] += 32
_CODE_VALUE = mixed(np.arange(256, dtype=np.uint64) + _U(1 << 40))
_M = _U(0x9E3779B97F4A7C15)


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first byte of each character, and a hash of each (A-Z as a-z)."""
    if not len(data) or data.max() < 0x80:
        return np.arange(len(data)), _CODE_VALUE[_LOWER[data]]
    first = np.flatnonzero((data & 0xC0) != 0x80)
    out = _CODE_VALUE[_LOWER[data[first]]]
    wide = np.flatnonzero(data[first] >= 0x80)
    code, inside = data[first[wide]].astype(np.uint64), np.ones(len(wide), bool)
    for k in range(1, 4):
        at = np.minimum(first[wide] + k, len(data) - 1)
        inside &= (data[at] & 0xC0 == 0x80) & (first[wide] + k < len(data))
        code = np.where(inside, code << _U(6) | data[at] & 0x3F, code)
    out[wide] = mixed(code + _U(1 << 40))
    return first, out


class Grams:
    """The features of some texts. A section is (place of its texts' symbols, [(n, weight of each n-gram)]); n-grams that would
    reach into the next text are left out by their places."""

    def __init__(self, words: Words):
        self.rows = len(words.offsets) - 1
        first, value = _characters(words.data)
        at = np.searchsorted(first, words.offsets)
        kind, row = _CLASS[words.data[first]], np.repeat(np.arange(self.rows), np.diff(at))
        if len(kind) > 2:  # of a run of equal kinds of letters two count
            same = (kind[2:] <= 2) & (kind[2:] == kind[1:-1]) & (kind[2:] == kind[:-2]) & (row[2:] == row[:-2])
            stay = np.concatenate([[True, True], ~same])
            kind, row = kind[stay], row[stay]
        self.sections = [
            (np.searchsorted(row, np.arange(self.rows + 1)), _hashed(_KIND_VALUE[kind], KINDS, KIND_BITS)),
            (at, _hashed(value, CHARS, CHAR_BITS)),
            (words.first, _hashed(words.hashes, WORDS, WORD_BITS)),
            (np.arange(self.rows + 1), [(1, _repeats(words))])]

    def logits(self, w: np.ndarray, a: int = 0, b: int | None = None) -> np.ndarray:
        """Values of the texts a to b by weights ``w``."""
        b = self.rows if b is None else b
        out = np.full(b - a, float(w[-1]))
        for (first, grams), base, width in zip(self.sections, _AT, np.diff(_AT), strict=False):
            begin, end, own = first[a:b], first[a + 1 : b + 1], w[base : base + width]
            total, count = np.zeros(b - a), np.zeros(b - a, np.int64)
            for n, index in grams:
                start = np.minimum(begin, len(index))  # texts shorter than n at the end have no place
                last = np.maximum(end - n + 1, start)
                low = int(start.min(initial=len(index)))
                sums = np.concatenate([np.zeros(1), np.cumsum(own[index[low : int(last.max(initial=low))]])])
                total += sums[last - low] - sums[start - low]
                count += last - start
            out += total / np.maximum(count, 1)
        return out

    def gradient(self, g: np.ndarray, a: int, b: int) -> np.ndarray:
        """By the weights, of what has derivatives ``g`` by the values of the texts a to b."""
        out = np.zeros(WIDTH)
        out[-1] = g.sum()
        for (first, grams), base, width in zip(self.sections, _AT, np.diff(_AT), strict=False):
            begin, end = first[a:b], first[a + 1 : b + 1]
            count = sum(np.maximum(end - n + 1 - begin, 0) for n, _ in grams)
            share = np.repeat(g / np.maximum(count, 1), end - begin)
            for n, index in grams:
                own = index[begin[0] : end[-1]]
                part = share[: len(own)]
                if n > 1:  # the last n - 1 places of a text begin none of its n-grams
                    part = part.copy()
                    over = (end[:, None] - np.arange(1, n)[None, :]).ravel() - begin[0]
                    part[over[(over >= 0) & (over < len(part))]] = 0
                out[base : base + width] += np.bincount(own, part, minlength=width)
        return out


def _hashed(value: np.ndarray, lengths: tuple[int, ...], bits: int) -> list[tuple[int, np.ndarray]]:
    """(n, cell of the n-gram at each place) for the lengths, by the first bits of a rolling hash."""
    out, code = [], value
    for n in range(1, max(lengths) + 1):
        if n > 1:
            code = code[:-1] * _M
            code += value[n - 1 :]
        if n in lengths:
            out.append((n, (code >> _U(64 - bits)).view(np.int64)))
    return out


def _repeats(words: Words) -> np.ndarray:
    """A cell for each text by the share of its words that came before, of 8 steps, and by its length, of 4."""
    n = words.counts
    key = distinct(words.text_of.astype(np.uint64) << _U(44) | words.hashes >> _U(20))
    new = np.bincount((key >> _U(44)).view(np.int64), minlength=len(n))
    share = (8 * (1 - new / np.maximum(n, 1))).astype(np.int64).clip(0, 7)
    return share * 4 + np.searchsorted([20, 100, 500], n, side="right")


def valued(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` without its texts, with ``value``."""
    sent, names = docs.sparkSession.sparkContext.broadcast(weights), [c for c in docs.columns if c != "text"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=ROWS_A_SLICE):
            z = Grams(Words(batch.column("text"), exact=True)).logits(sent.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(z)], names=[*names, "value"])

    return docs.mapInArrow(task, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != "text") + ", value double")
