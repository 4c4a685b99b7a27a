"""Packing documents into training sequences by shortest-pack-first over the histogram of lengths.

1. Each task tokenises its documents, cuts them into pieces of at most ``length`` tokens and numbers the pieces of each
   length that it has made (``pieces``). The pieces are written once: tokenising is the dear part.
2. The histogram of lengths has at most ``length`` bins, whatever the corpus is; only it goes to the driver. There
   ``patterns`` places lengths longest first, each into the shortest pack that has room, for whole counts of equal packs.
3. A window over (length, task) counts makes each piece's number within its task its rank within its length, without
   bringing the pieces of a length together: a length that a third of all pieces share is no hot key. Patterns use up ranks
   in runs, so a piece finds its sequence and offset by a binary search in a table of runs whose size follows the patterns.

Defined results: a null text is empty and has the end id alone; repeated rows and ids, null ids too, are packed each;
an empty table packs into no pieces; extra columns of ``docs`` are not read.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.llm.common import Words, ragged, slices, written

LENGTH = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
MEMO = 600_000
SLICE_BYTES = 2 << 20

#: ASCII marks without the apostrophe, which this tokeniser may take with the letters behind it.
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[b for b in range(0x41, 0x7B) if chr(b).isalpha()]] = True
#: Second bytes of U+00C0 to U+00FF that are letters.
_LATIN = np.zeros(256, bool)
_LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
_LETTERS = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]+")
#: Byte-level merges see each byte as a printable character: itself, or the next one from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_AS_PRINTED = {b: chr(b) for b in _PRINTABLE} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def _marks_begin(data: np.ndarray) -> np.ndarray:
    """Where a mark follows a Latin letter: this tokeniser always cuts there, unless a special token's text is near."""
    cut = np.zeros(len(data), bool)
    if len(data) > 2 and b"<|" not in data.tobytes():
        letter = _LETTER[data]
        letter[1:] |= (data[:-1] == 0xC3) & _LATIN[data[1:]]
        cut[1:] = _MARK[data[1:]] & letter[:-1]
    return cut


class WordEncoder:
    """Token ids of whole texts, each distinct word encoded once.

    This tokeniser folds case and drops white space before its merges, and no token spans white space, so a text's ids are the
    ids of its words end to end. Words are known by their 64-bit hashes. The memo is emptied at MEMO words: that costs time,
    not results.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[int, bytes] = {}

    def _encode(self, word: str) -> bytes:
        if not _LETTERS.fullmatch(word):
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        else:
            word = word.lower()
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(_AS_PRINTED)
            ids = [t.id for t in self.tokenizer.model.tokenize(word)]
        return np.array(ids, "<u4").tobytes()

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end and each text's first (one more than texts)."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        words = Words(texts, breaks=_marks_begin)
        distinct, at, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        known = distinct.tolist()
        coded = [self.memo.get(h) for h in known]
        for k, code in enumerate(coded):
            if code is None:
                coded[k] = self.memo[known[k]] = self._encode(words.word(at[k]).decode())
        ids, lengths = np.frombuffer(b"".join(coded), "<u4"), np.fromiter((len(x) // 4 for x in coded), np.int64, len(coded))
        starts, of_word = np.cumsum(lengths) - lengths, lengths[which]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(of_word)])
        return ids[ragged(starts[which], of_word)], ends[words.first]


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def word_encoder(path: str | None = None) -> Callable[[], WordEncoder]:
    """Makes an encoder of the tokeniser file at ``path`` in the task; a worker keeps it."""
    return functools.partial(_encoder, path or public_tokenizers.path(TOKENIZER))


PIECE = "doc_id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task int, nth bigint"


def pieces(docs: DataFrame, encoder: Callable, length: int = LENGTH, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """The pieces of each document; ``nth`` counts those of equal length within the task. keep_ids adds the ids themselves."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(), TaskContext.get().partitionId()
        made: defaultdict[int, int] = defaultdict(int)
        for batch in slices(batches, size=SLICE_BYTES):
            ids, first = encode(batch.column("text"))
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                own = np.append(ids[first[i] : first[i + 1]], np.uint32(end_id)).astype("<u4")
                for a in range(0, len(own), length):
                    part = own[a : a + length]
                    rows.append((i, a, len(part), zlib.crc32(part.tobytes()), len(own), made[len(part)], part if keep_ids else None))
                    made[len(part)] += 1
            doc, start, size, crc, total, nth, kept = zip(*rows, strict=True)
            columns = {"doc_id": batch.column("doc_id").take(pa.array(doc)), "start": pa.array(start, pa.int64()), "length": pa.array(size, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(total, pa.int64()), "task": pa.array([task] * len(rows), pa.int32()), "nth": pa.array(nth, pa.int64())}
            if keep_ids:
                columns["ids"] = pa.array([x.astype(np.int32) for x in kept], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    own = docs.select("doc_id", "text")
    return own.mapInArrow(cut, PIECE.format(id=own.schema["doc_id"].dataType.simpleString()) + ", ids array<int>" * keep_ids)


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of packs: the lengths of ``histogram`` longest first, each into the shortest pack with room."""
    packs: defaultdict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)  # by their sum
    sums: list[int] = []
    for size in sorted((k for k, n in histogram.items() if n), reverse=True):
        left = histogram[size]
        sums = sorted(s for s, x in packs.items() if x)
        for s in sums:
            if s + size > length:
                break
            # packs that this size has just filled wait for the next size, unless it fits into them again
            while left and packs[s]:
                count, own = packs[s].pop()
                used = min(count, left)
                if count > used:
                    packs[s].append((count - used, own))
                packs[s + size].append((used, (*own, size)))
                left -= used
        if left:
            for s, x in _filled(left, size, length):
                packs[s].append(x)
    return [x for s in sorted(packs) for x in packs[s]]


def _filled(count: int, size: int, length: int) -> list[tuple[int, tuple[int, tuple[int, ...]]]]:
    """Packs of one size alone for ``count`` pieces: as many in each as fit."""
    each = length // size
    out = [(size * each, (count // each, (size,) * each))] if count >= each else []
    return out + [(size * (count % each), (1, (size,) * (count % each)))] * bool(count % each)


def runs(packs: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: ranks from the first on go to sequences from the first on."""
    used: defaultdict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for count, sizes in packs:
        at = 0
        for size in sizes:
            out.append((size, used[size], sequence, at))
            used[size] += count
            at += size
        sequence += count
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, encoder: Callable | None = None, length: int = LENGTH, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents (``pieces``) with sequence_id and offset."""
    spark = docs.sparkSession
    cut = written(pieces(docs, encoder or word_encoder(), length, end_id, keep_ids))
    counts = written(cut.groupBy("length", "task").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `length` rows
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    table = spark.sparkContext.broadcast(runs(patterns(histogram, length)))
    columns = [c for c in cut.columns if c not in ("task", "nth")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        key = known[:, 0] << 48 | known[:, 1]
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            k = np.searchsorted(key, size << 48 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(known[k, 2] + rank - known[k, 1]), pa.array(known[k, 3])], names=[*columns, "sequence_id", "offset"])

    ranked = cut.join(bases, ["length", "task"]).select(*columns, (F.col("base") + F.col("nth")).alias("rank"))
    kinds = ", ".join(f"{c} {cut.schema[c].dataType.simpleString()}" for c in columns)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence of ``pack(..., keep_ids=True)``: its ids in order; a sequence has at most ``length`` of them."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
