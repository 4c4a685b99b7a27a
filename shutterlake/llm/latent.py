"""Benchmark decontamination by latent semantic retrieval, then longest common subsequences and answer checks.

Only words of the benchmark can make a passage like an item, so the columns of the TF-IDF matrix are the benchmark's distinct
words, without those in more than STOP of the documents that are in no item's rarer half of words; frequencies are counted over all documents. A randomised SVD (Halko et al., 2011) of TF-IDF passages gives
RANK right singular vectors: the passages are the items and those of all documents, which one pass over the texts writes as columns; the products with the passage matrix are partial sums per task, added up in Spark, and the driver factors matrices of
RANK + EXTRA columns. Every document is then cut into overlapping windows, at sizes that double from WINDOW to the longest
item; a window's vector is the sum of its words' latent vectors. It is a candidate for the items of its size whose cosine with
it is COSINE at least and which it reaches: its part along the item's vector has REACH of that vector's length.

Weights make the cosine miss a passage that many documents have if its rarest words differ from the item's, so places with
enough of an item's rarer words are candidates too (``rare_candidates``): whatever the cosine says, none that could pass is lost.

A candidate window, with as many words on each side as the item has, is compared with the item word by word: the longest common
subsequence must have VERBATIM of the item's words, or PARAPHRASE of them and the answer: the item's ``answer`` if that column is
there, else the words of its last sentence, in order, ANSWER of them. Common words alone don't count: of the item's rarer half
of words, RARE must be in the subsequence.

Items go to the workers in blocks of ITEMS, so what is broadcast is bounded whatever the benchmark is; each block is a pass.

Defined results: null and empty texts match nothing; items without words match nothing; documents repeated or without id are
matched each; items without id or repeated are items of their own; with no items or documents there are no rows; extra
columns are not read (of items, ``answer`` is).
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import Words, batches_of, distinct, ragged, scratch, slices

RANK, EXTRA, POWER = 64, 16, 1
ITEMS = 2_048
WINDOW, STEPS, PASSAGE = 16, 3, 64
STOP = 0.05
COSINE, REACH = 0.6, 0.4
VERBATIM, PARAPHRASE, ANSWER, RARE = 0.8, 0.6, 0.8, 0.5
BLOCK = 1_024
#: Of ``known_words``; a passage has no more than PASSAGE words.
KINDS = {"i": np.int32, "df": np.int32, "size": np.uint8, "column": np.int32, "tf": np.uint8}
#: Entries and windows at a time, so that their vectors stay in a core's cache.
ENTRIES, WINDOWS = 1 << 10, 1 << 12
_U = np.uint64


@dataclasses.dataclass
class Item:
    item_id: object
    words: np.ndarray  # hashes
    answer: np.ndarray


def _last_sentence(text: str) -> str:
    parts = [x for x in re.split(r"(?<=[.!?])\s+|\n", text) if x.strip()]
    return parts[-1] if parts else ""


def items_of(benchmark: DataFrame) -> Iterator[list[Item]]:
    """The benchmark's items in blocks; the driver holds one block at a time."""
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    own = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"), answer.alias("answer"))
    block: list[Item] = []
    for r in own.toLocalIterator():
        answer = r["answer"] if r["answer"] is not None else _last_sentence(r["text"])
        w = Words(pa.array([r["text"], answer]))
        item = Item(r["item_id"], w.hashes[: w.first[1]], w.hashes[w.first[1] :])
        if len(item.words):
            block.append(item)
        if len(block) == ITEMS:
            yield block
            block = []
    if block:
        yield block


def _columns(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The column of each word, -1 for words that no item has."""
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, -1)


def known_words(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """The vocabulary's words in all documents, a row for each slice of a task: n documents, in df of them the word i; and of the slice's
    passages of PASSAGE words one after another how many distinct words each has, which (column) and how often (tf). All but n are
    arrays' bytes, which Spark writes many times faster than arrays."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        for batch in slices(batches):
            words = Words(batch.column("text"))
            column = _columns(v, words.hashes)
            known = np.flatnonzero(column >= 0)
            text, column = words.text_of[known], column[known]
            df = np.bincount(distinct(text * len(v) + column) % len(v), minlength=len(v))
            at = np.flatnonzero(df)
            own = text * (1 << 40) + (known - words.first[text]) // PASSAGE
            passage = np.cumsum(np.diff(own, prepend=own[:1]) != 0)
            key = np.sort(passage * len(v) + column)
            first = np.flatnonzero(np.diff(key, prepend=-1))
            row = {"i": at, "df": df[at], "size": np.bincount(key[first] // len(v)), "column": key[first] % len(v), "tf": np.diff(np.append(first, len(key)))}
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())} | {k: pa.array([x.astype(KINDS[k]).tobytes()], pa.binary()) for k, x in row.items()})

    return docs.select("text").mapInArrow(task, "n bigint, " + ", ".join(f"{k} binary" for k in KINDS))


def _arrays(batch: pa.RecordBatch, *names: str) -> Iterator[list[np.ndarray]]:
    """These columns of each row of ``known_words``."""
    for row in zip(*(batch.column(k) for k in names), strict=True):
        yield [np.frombuffer(x.as_buffer(), KINDS[k]) for k, x in zip(names, row, strict=True)]


def frequencies(known: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """In how many documents each word of the vocabulary is, and how many there are."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(width, np.int64)
        for batch in batches:
            for i, own in _arrays(batch, "i", "df"):
                df[i] += own
            n += sum(batch.column("n").to_pylist())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.append(at, -1).astype(np.int32)), "n": pa.array(np.append(df[at], n))})

    got = known.select("n", "i", "df").mapInArrow(task, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(width + 1, np.int64)
    out[got.column("i").to_numpy()] = got.column("n").to_numpy()
    return out[:-1], int(out[-1])


def _sums(rows: np.ndarray, of: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each ``first`` and ``n``, 1 at least, the sum of rows[of[first]] to rows[of[first + n - 1]]: all the first ones, then all the
    second, which is many times faster here than ``np.add.reduceat``."""
    order = np.argsort(-n, kind="stable")
    first, n = first[order], n[order]
    total = rows[of[first]]
    part = np.empty_like(total)  # once: memory that is new for each part costs more than the sums
    for k, m in enumerate(np.searchsorted(-n, -np.arange(1, n[0] if len(n) else 1)).tolist(), 1):
        np.take(rows, of[first[:m] + k], axis=0, out=part[:m], mode="clip")
        total[:m] += part[:m]
    out = np.empty_like(total)
    out[order] = total
    return out


def _multiply(total: np.ndarray, column: np.ndarray, tf: np.ndarray, size: np.ndarray, idf: np.ndarray, q: np.ndarray) -> None:
    """Adds X^T X q for passages of ``size`` entries (column, tf), each a TF-IDF vector of length 1; column is -1 for words that are left out."""
    here = column >= 0
    passage = np.repeat(np.arange(len(size)), size)[here]
    column, x = column[here], tf[here] * idf[column[here]]
    x /= np.sqrt(np.bincount(passage, x * x, minlength=len(size)))[passage]
    ends = np.cumsum(np.bincount(passage, minlength=len(size)))
    cuts = distinct(np.append(ends[np.searchsorted(ends, np.arange(ENTRIES, len(x), ENTRIES))], [0, len(x)]).astype(np.int64))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        c, p, w = column[a:b], passage[a:b], x[a:b, None]
        first = np.flatnonzero(np.diff(p, prepend=-1))
        product = _sums(w * q[c], np.arange(b - a), first, np.diff(np.append(first, b - a)))
        order = np.argsort(c, kind="stable")
        first = np.flatnonzero(np.diff(c[order], prepend=-1))
        number = np.cumsum(np.diff(p, prepend=p[:1]) != 0)
        total[c[order][first]] += _sums(w * product[number], order, first, np.diff(np.append(first, b - a)))


def latent_space(known: DataFrame, items: list[Item], vocabulary: np.ndarray, idf: np.ndarray, place: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Latent vectors of the vocabulary's words: idf times the right singular vectors of the TF-IDF passages of all documents and the items.

    place: each known word's place in the vocabulary, -1 for those that are not in it."""
    width, spark = len(vocabulary), known.sparkSession
    rank = min(rank, width)
    columns = min(rank + EXTRA, width)
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((width, columns)))[0]
    sent = spark.sparkContext.broadcast((place, idf))

    def product(q: np.ndarray) -> np.ndarray:
        """A^T A q over all passages, as sums of BLOCK rows per task, and over the items."""
        right = spark.sparkContext.broadcast(q)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (at, weight), r = sent.value, right.value
            total = np.zeros((len(weight), r.shape[1]))
            for batch in batches:
                for column, tf, size in _arrays(batch, "column", "tf", "size"):
                    _multiply(total, at[column], tf, size, weight, r)
            for k in range(0, len(total), BLOCK):
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "part": pa.array([total[k : k + BLOCK].tobytes()], pa.binary())})

        def added(group: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x) for x in group.column("part").to_pylist())
            return pa.Table.from_pydict({"k": group.column("k")[:1], "part": pa.array([total.tobytes()], pa.binary())})

        out = np.zeros((width, q.shape[1]))
        for x in items:
            c = _columns(vocabulary, x.words)
            _add(out, c[c >= 0], idf, q)
        parts = known.select("column", "tf", "size").mapInArrow(task, "k int, part binary").groupBy("k").applyInArrow(added, "k int, part binary")
        with batches_of(spark):
            for r in parts.toLocalIterator():
                block = np.frombuffer(r["part"]).reshape(-1, q.shape[1])
                out[r["k"] : r["k"] + len(block)] += block
        right.destroy()
        return out

    for _ in range(POWER + 1):
        q = np.linalg.qr(product(q))[0]
    # A^T A in the basis q: its eigenvectors turn q into singular vectors, largest first
    small = q.T @ product(q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return (idf[:, None] * (q @ vectors[:, np.argsort(-values)[:rank]])).astype(np.float32)


def _add(total: np.ndarray, columns: np.ndarray, idf: np.ndarray, q: np.ndarray) -> None:
    """Adds x (x^T q) for one passage's TF-IDF vector x of length 1."""
    own, tf = np.unique(columns, return_counts=True)
    x = tf * idf[own]
    norm = np.sqrt((x * x).sum())
    if norm:
        x /= norm
        total[own] += np.outer(x, x @ q[own])


#: Tables of more cells are not made whole.
TABLE = 1 << 24


def _last_row(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``text`` with each beginning of ``item``."""
    row = np.zeros(len(item) + 1, np.int32)
    for w in text:
        new = row.copy()
        new[1:] = np.maximum(row[1:], row[:-1] + (item == w))
        row = np.maximum.accumulate(new)
    return row


def common_subsequence(item: np.ndarray, text: np.ndarray) -> tuple[int, np.ndarray]:
    """Length of the longest common subsequence of two word sequences, and whether each of the item's words is in one.

    Long ones are halved where the lengths before and behind add up to the most (Hirschberg, 1975), so memory is that of a row.
    """
    n = len(item)
    if n > 1 and len(text) > 1 and (n + 1) * (len(text) + 1) > TABLE:
        half = len(text) // 2
        before, behind = _last_row(item, text[:half]), _last_row(item[::-1], text[half:][::-1])[::-1]
        cut = int(np.argmax(before + behind))
        parts = common_subsequence(item[:cut], text[:half]), common_subsequence(item[cut:], text[half:])
        return parts[0][0] + parts[1][0], np.concatenate([parts[0][1], parts[1][1]])
    table = np.zeros((len(text) + 1, n + 1), np.int16 if n < 1 << 15 else np.int32)
    for k, w in enumerate(text, 1):
        row = np.maximum(table[k - 1], 0)
        row[1:] = np.maximum(row[1:], table[k - 1][:-1] + (item == w))
        table[k] = np.maximum.accumulate(row)
    used, i, j = np.zeros(n, bool), len(text), n
    while i and j:
        if table[i, j] == table[i, j - 1]:
            j -= 1
        elif table[i, j] == table[i - 1, j]:
            i -= 1
        else:
            used[j - 1] = True
            i, j = i - 1, j - 1
    return int(table[-1, -1]), used


def subsequence_length(item: np.ndarray, text: np.ndarray) -> int:
    """The length alone, by bits of one integer per item word (Hyyro, 2004)."""
    masks: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    v = full
    for w in text.tolist():
        if m := masks.get(w):
            u = v & m
            v = (v + u | v - u) & full
    return len(item) - v.bit_count()


def verdict(item: Item, rare: np.ndarray, text: np.ndarray) -> tuple[int, bool] | None:
    """(common words, whether the answer is there) if ``text`` has the item, else None. rare: which words are of the rarer half."""
    need = int(np.ceil(PARAPHRASE * len(item.words)))
    common = subsequence_length(item.words, text)
    if common < need:
        return None
    _, used = common_subsequence(item.words, text)
    if (used & rare).sum() < RARE * rare.sum():
        return None
    found = bool(len(item.answer)) and subsequence_length(item.answer, text) >= ANSWER * len(item.answer)
    return (common, found) if common >= VERBATIM * len(item.words) or found else None


@dataclasses.dataclass
class Index:
    """A block of items as the workers need them."""

    items: list[Item]
    rare: list[np.ndarray]
    asked: list[list[int]]  # the rarer words, repeated ones as often
    vocabulary: np.ndarray
    latent: np.ndarray
    by_size: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]  # window size, indices of its items, their unit vectors and lengths
    need: np.ndarray  # how many of its rarer words each item needs
    rarer: tuple[np.ndarray, np.ndarray, np.ndarray]  # each item's first (one more than items); distinct rarer columns, how often each
    first_met: tuple[np.ndarray, np.ndarray]  # each column's first (one more than columns); items that can't be there without one of these


def indexed(docs: DataFrame, items: list[Item]) -> Index:
    vocabulary = np.unique(np.concatenate([x.words for x in items]))
    with scratch(known_words(docs, vocabulary)) as known:
        df, n = frequencies(known, len(vocabulary))
        rare = []
        for x in items:
            weight = -df[_columns(vocabulary, x.words)]
            rare.append(weight >= np.median(weight))
        # each item keeps its rarer half, frequent or not
        kept = np.unique(np.concatenate([c[(df[c] <= STOP * n) | r] for x, r in zip(items, rare, strict=True) for c in [_columns(vocabulary, x.words)]]))
        place = np.full(len(vocabulary), -1)
        place[kept] = np.arange(len(kept))
        vocabulary, idf = vocabulary[kept], np.log((n + 1) / (df[kept] + 1)) + 0.01
        latent = latent_space(known, items, vocabulary, idf, place)
    vectors = np.array([latent[c[c >= 0]].sum(0) for x in items for c in [_columns(vocabulary, x.words)]])
    lengths = np.linalg.norm(vectors, axis=1)
    vectors /= np.maximum(lengths, 1e-12)[:, None]
    windows = [WINDOW]
    while max(len(x.words) for x in items) > windows[-1] + windows[-1] // 4:
        windows.append(2 * windows[-1])
    sizes = np.array([next(k for k in windows if len(x.words) <= k + k // 4) for x in items])
    own = [_columns(vocabulary, x.words[r]) for x, r in zip(items, rare, strict=True)]
    need = np.array([int(np.ceil(RARE * len(c))) for c in own])
    each = [np.unique(c, return_counts=True) for c in own]
    # where need of its rarer words are, one of all but the need - 1 most frequent is
    met = [np.unique(c[np.argsort(df[kept][c], kind="stable")][: len(c) - k + 1]) for c, k in zip(own, need, strict=True)]
    column, item = np.concatenate(met), np.repeat(np.arange(len(items)), [len(c) for c in met])
    order = np.argsort(column, kind="stable")
    return Index(
        items, rare, [x.words[r].tolist() for x, r in zip(items, rare, strict=True)], vocabulary, latent,
        [(k, np.flatnonzero(sizes == k), vectors[sizes == k], lengths[sizes == k]) for k in windows if (sizes == k).any()], need,
        (np.append(0, np.cumsum([len(c) for c, _ in each])), np.concatenate([c for c, _ in each]), np.concatenate([m for _, m in each])),
        (np.searchsorted(column[order], np.arange(len(vocabulary) + 1)), item[order]))


def rare_candidates(words: Words, column: np.ndarray, index: Index, reach: np.ndarray, pairs: int = 1 << 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, place) of each word from which on, within ``reach`` words, an item's rarer words may be often enough."""
    width, many = len(index.vocabulary), len(index.items)
    known = np.flatnonzero(column >= 0)
    key = words.text_of[known] * width + column[known]
    order = np.argsort(key, kind="stable")
    key, known = key[order], known[order]
    have = distinct(key)
    begin, end = np.searchsorted(key, have), np.searchsorted(key, have, side="right")
    (of_column, met), (of_item, rarer, times) = index.first_met, index.rarer
    first, n = of_column[have % width], np.diff(of_column)[have % width]
    both = distinct(np.repeat(have // width, n) * many + met[ragged(first, n)])
    out = []
    for k in range(0, len(both), pairs):
        text, item = both[k : k + pairs] // many, both[k : k + pairs] % many
        n = np.diff(of_item)[item]
        at, pair = ragged(of_item[item], n), np.repeat(np.arange(len(item)), n)
        asked = text[pair] * width + rarer[at]
        found = np.minimum(np.searchsorted(have, asked), len(have) - 1)
        there = have[found] == asked
        enough = np.bincount(pair, times[at] * there, minlength=len(item)) >= index.need[item]
        there &= enough[pair]
        found, pair, at = found[there], pair[there], at[there]
        # each of the pair's words in order, as often as the item has it
        n = end[found] - begin[found]
        place, pair, often = known[ragged(begin[found], n)], np.repeat(pair, n), np.repeat(times[at], n)
        order = np.lexsort((place, pair))
        place, pair, often = place[order], pair[order], often[order]
        total, line = np.append(0, np.cumsum(often)), pair * (1 << 40) + place
        last = np.searchsorted(line, line + reach[item[pair]])
        some = total[last] - total[: len(line)] >= index.need[item[pair]]
        out.append((text[pair[some]], item[pair[some]], place[some]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros((3, 0), np.int64))


def candidates(words: Words, column: np.ndarray, index: Index, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, first word of the window) for each window that ``cosine`` and REACH let through for an item."""
    known = np.flatnonzero(column >= 0)
    column = column[known]
    norm = np.linalg.norm(index.latent, axis=1)
    mass = np.concatenate([np.zeros(1), np.cumsum(norm[column], dtype=np.float64)])
    rows, found, places = [], [], []
    for size, own, units, lengths in index.by_size:
        # windows begin at multiples of a step within their text; only those that hold known words are looked at
        step = size // STEPS
        row = words.text_of[known]
        block = (known - words.first[row]) // step
        begin = distinct(np.concatenate([row * (1 << 40) + np.maximum(block - k, 0) for k in range(STEPS)]))
        text, start = begin >> 40, (begin & ((1 << 40) - 1)) * step
        start += words.first[text]
        low = np.searchsorted(known, start)
        high = np.searchsorted(known, np.minimum(start + size, words.first[text + 1]))
        # a vector is no longer than its words' vectors together
        some = np.flatnonzero(mass[high] - mass[low] >= REACH * lengths.min() - 1e-6)
        for a in range(0, len(some), WINDOWS):
            part = some[a : a + WINDOWS]
            n = high[part] - low[part]
            part, n = part[n > 0], n[n > 0]
            if not len(part):
                continue
            vector = _sums(index.latent, column, low[part], n)
            like = vector @ units.T
            w, i = np.nonzero((like >= cosine * np.linalg.norm(vector, axis=1)[:, None]) & (like >= REACH * lengths))
            rows.append(text[part[w]])
            found.append(own[i])
            places.append(start[part[w]])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, found, places))


def matches(texts: pa.Array, index: Index) -> dict[tuple[int, int], tuple[int, bool]]:
    """By (text, item): the best verdict."""
    words = Words(texts)
    column = _columns(index.vocabulary, words.hashes)
    best: dict[tuple[int, int], tuple[int, bool]] = {}
    sizes, lengths = np.zeros(len(index.items), np.int64), np.array([len(x.words) for x in index.items])
    for size, own, *_ in index.by_size:
        sizes[own] = size
    around = np.maximum(sizes, lengths) + lengths + lengths // 2
    row, item, place = (np.concatenate(x) for x in zip(candidates(words, column, index), rare_candidates(words, column, index, around), strict=True))
    if not len(row):
        return best
    order = np.lexsort((place, item, row))
    row, item, place = row[order], item[order], place[order]
    n = lengths[item]
    low = np.maximum(words.first[row], place - n)
    high = np.minimum(words.first[row + 1], place + around[item])
    # of the rarer words, enough must be near: told by the known words there, which are few
    known = np.flatnonzero(column >= 0)
    hashes = words.hashes[known].tolist()
    first, end = np.searchsorted(known, low).tolist(), np.searchsorted(known, high).tolist()
    last = (-1, -1, 0)
    for k, (r, i, p) in enumerate(zip(row.tolist(), item.tolist(), place.tolist(), strict=True)):
        if last[:2] == (r, i) and p < last[2]:  # within what was just compared
            continue
        last = (r, i, p + lengths[i] // 2)
        near = set(hashes[first[k] : end[k]])
        if sum(h in near for h in index.asked[i]) < RARE * len(index.asked[i]):
            continue
        x = index.items[i]
        if got := verdict(x, index.rare[i], words.hashes[low[k] : high[k]]):
            best[r, i] = max(best.get((r, i), got), got)
    return best


_OUT = "doc_id {id}, item_id {item}, item_words bigint, common_words bigint, answer_found boolean"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_words, common_words, answer_found) of each row of ``docs`` and item that its text has."""
    spark, own, found = docs.sparkSession, docs.select("doc_id", "text"), []
    kinds = _OUT.format(id=own.dtypes[0][1], item=benchmark.schema["item_id"].dataType.simpleString())
    for block in items_of(benchmark):
        sent = spark.sparkContext.broadcast(indexed(own, block))

        def task(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in slices(batches):
                if best := matches(batch.column("text"), index):
                    items = [index.items[i] for _, i in best]
                    common, answered = zip(*best.values(), strict=True)
                    yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array([r for r, _ in best])), "item_id": pa.array([x.item_id for x in items]), "item_words": pa.array([len(x.words) for x in items]), "common_words": pa.array(common), "answer_found": pa.array(answered)})

        found.append(own.mapInArrow(task, kinds))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], kinds)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has no item of the benchmark; all columns stay."""
    spark, left = docs.sparkSession, docs
    for block in items_of(benchmark):
        sent = spark.sparkContext.broadcast(indexed(docs.select("text"), block))

        def task(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                clean = np.ones(batch.num_rows, bool)
                clean[[r for r, _ in matches(batch.column("text"), sent.value)]] = False
                yield batch.filter(pa.array(clean))

        left = left.mapInArrow(task, left.schema)
    return left
