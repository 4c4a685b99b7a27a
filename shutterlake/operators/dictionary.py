"""Terms of a dictionary in texts, the longest first and none over another, and what of a text is left without them.

The dictionary is a table (label, term) of bounded size; it goes to the tasks as sorted arrays of hashes, one array for each
length of term. A task hashes every place of a batch of texts at once (a polynomial in wrapping 64-bit arithmetic, so the hash of
any piece comes from two running sums), passes over places whose first two bytes begin no term, and looks the others up, length
by length, after a look at a table of the first bits of hashes. Hits are compared byte by byte, so a hash never decides alone. Only hits that touch others are settled in turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.batches import characters, parts, texts_of, utf8

#: A dictionary of more bytes is refused: it would not be a broadcast of bounded size.
MOST_BYTES = 64 << 20
_B = 0x9E3779B97F4A7C15
_INVERSE = pow(_B, -1, 1 << 64)
_VALUE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0x2545F4914F6CDD1D)


def normalised(text: Column) -> Column:
    """Lower case without white space; null is empty."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\x{A0}\x{3000}\x{FEFF}]+", ""))


class Terms:
    """The terms (label, term) of a dictionary, in the order in which they take places: longest first, then by label and term."""

    def __init__(self, rows: list[tuple[str, str]]):
        order = sorted({(-len(t), name, t) for name, t in rows if t})
        first: dict[str, str] = {}
        for _, name, t in order:
            first.setdefault(t, name)  # of labels with the same term the first has it
        self.terms, self.labels = list(first), list(first.values())
        own = [t.encode() for t in self.terms]
        self.begins = np.zeros(1 << 16, bool)
        self.single = np.zeros(256, bool)
        by_size: dict[int, list[int]] = {}
        for i, t in enumerate(own):
            by_size.setdefault(len(t), []).append(i)
            if len(t) > 1:
                self.begins[t[0] << 8 | t[1]] = True
            else:
                self.single[t[0]] = True
        self.by_size = []
        for size, at in sorted(by_size.items()):
            letters = np.frombuffer(b"".join(own[i] for i in at), np.uint8).reshape(-1, size)
            code = (_VALUE[letters] * _powers(size)[None, :]).sum(axis=1, dtype=np.uint64)
            order_ = np.argsort(code, kind="stable")
            shift = np.uint64(64 - max(10, (16 * len(at)).bit_length()))
            known = np.zeros(1 << (64 - int(shift)), bool)  # which first bits some term's hash has: one in 16 at most
            known[code >> shift] = True
            self.by_size.append((size, shift, known, code[order_], np.array(at)[order_], letters[order_]))

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, end, term) of each occurrence in the texts, in no order."""
        n = len(data)
        if not n or not self.terms:
            return (np.zeros(0, np.int64),) * 3
        next_ = np.append(data[1:], np.uint8(0)).astype(np.int64)
        at = np.flatnonzero(self.begins[data.astype(np.int64) << 8 | next_] | self.single[data])
        limit = offsets[np.searchsorted(offsets, at, side="right")]
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * _powers(n), dtype=np.uint64)])
        back = _powers(n, _INVERSE)
        out = []
        for size, shift, known, codes, terms, letters in self.by_size:
            p = at[at + size <= limit]
            code = (running[p + size] - running[p]) * back[p]
            may = known[code >> shift]
            p, code = p[may], code[may]
            found = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            same = codes[found] == code
            p, found = p[same], found[same]
            true = (data[p[:, None] + np.arange(size)[None, :]] == letters[found]).all(axis=1)
            out.append((p[true], p[true] + size, terms[found[true]]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def placed(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The occurrences that take their places, in the order of the texts."""
        start, end, term = self.hits(data, offsets)
        order = np.argsort(start, kind="stable")
        start, end, term = start[order], end[order], term[order]
        if not len(start):
            return start, end, term
        # hits that overlap, by one another, make a group; those of a group settle among themselves
        new = np.concatenate([[True], start[1:] >= np.maximum.accumulate(end)[:-1]])
        size = np.diff(np.append(np.flatnonzero(new), len(start)))
        touch = np.repeat(size > 1, size)
        stay, taken = ~touch, set()
        for i in sorted(np.flatnonzero(touch), key=lambda i: (term[i], start[i])):
            own = range(start[i], end[i])
            if taken.isdisjoint(own):
                taken.update(own)
                stay[i] = True
        return start[stay], end[stay], term[stay]


def _powers(n: int, base: int = _B) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), base, np.uint64), dtype=np.uint64)])[:n]


def matched(texts: DataFrame, terms: DataFrame, column: str = "text", cut: bool = False) -> DataFrame:
    """``texts`` with ``matches``, an array of (label, term, start, end) in the order of the text (characters from 0), of the terms of
    ``terms`` (label, term) in ``column``; with ``cut`` also ``residual``, the text without them, and ``segments``, its pieces.

    Terms and texts should be ``normalised`` alike. Null texts have no matches; blank terms are passed over.
    """
    rows = terms.select("label", "term").where("label IS NOT NULL AND term <> ''").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("term") + F.octet_length("label")), F.lit(0))).first()[0]
    if size > MOST_BYTES:
        raise ValueError(f"a dictionary of {size} bytes; {MOST_BYTES} at most")
    got = rows.toArrow()
    sent = texts.sparkSession.sparkContext.broadcast(Terms(list(zip(got.column("label").to_pylist(), got.column("term").to_pylist(), strict=True))))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        labels, words = pa.array(own.labels, pa.string()), pa.array(own.terms, pa.string())
        for whole in batches:
            for batch in parts(whole, column):
                data, offsets = utf8(batch.column(column))
                start, end, term = own.placed(data, offsets)
                before, text = characters(data), np.searchsorted(offsets, start, side="right") - 1
                zero = before[offsets[text]]
                fields = [labels.take(pa.array(term)), words.take(pa.array(term)), pa.array((before[start] - zero).astype(np.int32)), pa.array((before[end] - zero).astype(np.int32))]
                first = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32))
                columns = [*batch.columns, pa.ListArray.from_arrays(first, pa.StructArray.from_arrays(fields, ["label", "term", "start", "end"]))]
                if cut:
                    left = np.ones(len(data) + 1, bool)
                    left[np.repeat(start - np.cumsum(end - start) + (end - start), end - start) + np.arange((end - start).sum())] = False
                    kept = np.concatenate([np.zeros(1, np.int64), np.cumsum(left[:-1])])
                    columns.append(texts_of(data[left[:-1]], kept[offsets]))
                    begins = left[:-1].copy()
                    begins[1:] &= ~left[:-2]
                    begins[offsets[:-1][offsets[:-1] < len(data)]] = left[offsets[:-1][offsets[:-1] < len(data)]]
                    own_at = np.flatnonzero(begins)
                    pieces = texts_of(data[left[:-1]], np.append(kept[own_at], kept[-1]))
                    columns.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(own_at, offsets).astype(np.int32)), pieces))
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "matches", *(["residual", "segments"] if cut else [])])

    kinds = ", ".join(f"`{c}` {t}" for c, t in texts.dtypes) + ", matches array<struct<label: string, term: string, start: int, end: int>>"
    return texts.mapInArrow(task, kinds + (", residual string, segments array<string>" if cut else ""))


def without(text: Column, ranges: Column) -> Column:
    """The pieces of ``text`` outside ``ranges``, an array of (start, end) that may overlap; empty pieces are left out."""
    ordered = F.array_sort(F.transform(ranges, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("pieces"))

    def step(state: Column, r: Column) -> Column:
        piece = F.when(r["start"] > state["at"], F.array(text.substr(state["at"] + 1, r["start"] - state["at"]))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(state["at"], r["end"]).alias("at"), F.concat(state["pieces"], piece).alias("pieces"))

    def last(state: Column) -> Column:
        return F.filter(F.concat(state["pieces"], F.array(text.substr(state["at"] + 1, F.length(text)))), lambda x: x != "")

    return F.aggregate(ordered, begin, step, last)
