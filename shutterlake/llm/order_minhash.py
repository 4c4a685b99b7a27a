"""Near-duplicate texts by order MinHash, verified by banded alignment.

A text is the sequence of its 5-word shingles (A-Z as a-z), each labelled with its occurrence in the text, so labels are
distinct. One sketch takes the ELEMENTS labels of smallest hash and keeps them in text order (Marcais et al., 2019): two texts
agree on it only if they have these labels in common and in the same order. SKETCHES sketches make as many bucket keys; at
similarity 0.8 a pair meets in one of them with probability 1 - (1 - 0.8 ** 3) ** 14 > 0.9999.

similarity = L / (n1 + n2 - L), with n1, n2 the numbers of shingles and L the longest common subsequence: the Jaccard
similarity of shingles in an alignment that keeps the order. Labels are distinct in a text, so L is the longest increasing run
of matched places; places differ by at most the indels that THRESHOLD leaves, (n1 + n2) / 9, which is the band.

Jobs: 1. one pass over the texts writes sketches; exact copies (128-bit hash) are one text from there on. 2. Each
bucket's texts are compared with one of its texts, a leader, which makes a star and no pairs; the links found join texts into
classes. 3. In buckets that
still hold more than one class, the texts of different classes are compared: as pairs in small buckets; in large ones in blocks
of texts, whose numbers of common labels come from matrix products, so that no pairs are made but of those that may be near. So no pair of texts of different classes that meets in a bucket is left uncompared. Classes are connected components.

Defined results: a null text is empty; texts with fewer words than a shingle have one shingle (all their words), so they match
only if equal, word by word; texts without words only if equal exactly; a null doc_id is in its text's class, whose name is the smallest
doc_id, null if all are null; repeated rows are rows of the class; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import Words, mixed, seeds, slices, written

SHINGLE = 5
ELEMENTS, SKETCHES = 3, 14
THRESHOLD = 0.8
#: Buckets of more texts than FEW are looked at in blocks of BLOCK texts, by COLUMNS labels at a time.
FEW, BLOCK, COLUMNS = 32, 512, 4096
#: Keys of more than HOT rows are split in joins; in large tables of more rows, so that there are at most MOST_HOT of them.
HOT, MOST_HOT = 1_000, 100_000
_U = np.uint64
_SEEDS, _ODD = seeds(SKETCHES, 5), seeds(SKETCHES, 6) | _U(1)


def rolled(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of texts with word hashes ``h``, and each text's first; an empty text has none."""
    n = np.diff(first)
    counts = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
    starts = np.repeat(first[:-1] - at[:-1], counts) + np.arange(at[-1])
    ends = np.repeat(first[1:], counts)
    out = np.zeros(at[-1], np.uint64)
    padded = np.append(h, np.zeros(SHINGLE, np.uint64))
    for k in range(SHINGLE):
        out = mixed(out * _U(31) + np.where(starts + k < ends, padded[np.minimum(starts + k, len(h))], _U(k + 1)))
    return out, at


def labelled(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Shingles with the number of their occurrence in the text mixed in."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    own = shingles ^ mixed(row.astype(np.uint64) + _U(1))
    order = np.argsort(own, kind="stable")
    s = own[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    nth = np.arange(len(s)) - np.repeat(begin, np.diff(np.append(begin, len(s))))
    out = shingles.copy()
    out[order] = mixed(shingles[order] + nth.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    return out


def sketches(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bucket keys, SKETCHES a text."""
    n = np.diff(first)
    rows = len(n)
    row = np.repeat(np.arange(rows), n)
    out = np.zeros((rows, SKETCHES), np.uint64)
    if not len(labels):
        return out
    want = np.minimum(n, ELEMENTS)
    # about 4 times as many labels pass as are needed; texts of which too few pass are looked at whole
    bar = np.where(n > 4 * ELEMENTS, (4 * ELEMENTS / np.maximum(n, 1) * 2.0**64).clip(0, 2.0**64 - 2**12), 2.0**64 - 2**12).astype(np.uint64)
    bar[n <= 4 * ELEMENTS] = _U(0xFFFFFFFFFFFFFFFF)
    bars = bar[row]
    for i in range(SKETCHES):
        value = (labels ^ _SEEDS[i]) * _ODD[i]
        value ^= value >> _U(32)
        pick = np.flatnonzero(value <= bars)
        short = np.flatnonzero(np.bincount(row[pick], minlength=rows) < want)
        if len(short):
            pick = np.union1d(pick, np.concatenate([np.arange(first[k], first[k + 1]) for k in short]))
        order = np.lexsort((value[pick], row[pick]))
        r = row[pick][order]
        begin = np.searchsorted(r, np.arange(rows))
        rank = np.arange(len(r)) - begin[r]
        kept = np.sort(pick[order][rank < ELEMENTS])  # in text order again
        r = row[kept]
        place = np.arange(len(r)) - np.searchsorted(r, np.arange(rows))[r]
        key = np.full(rows, _SEEDS[i])
        for k in range(ELEMENTS):
            here = kept[place == k]
            key[row[here]] = mixed(key[row[here]] * _U(5) + labels[here])
        out[:, i] = key
    return out


#: A row's text as 128 bits, and its id as what no id is not; names that no table is likely to have.
KEYS = ["__omh_a", "__omh_b", "__omh_id"]


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns(dict(zip(KEYS, (F.xxhash64(text), F.xxhash64(F.lit(1), text, F.lit(2)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), strict=True)))


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, KEYS, n, buckets) of each row: n shingles, and the text's bucket keys."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column("text"))
            shingles, first = rolled(words.hashes, words.first)
            keys = sketches(labelled(shingles, first), first).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * SKETCHES), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("doc_id", *KEYS)} | {"n": pa.array(np.diff(first)), "buckets": lists})

    own = keyed(docs.select("doc_id", "text"))
    return own.mapInArrow(task, f"doc_id {own.dtypes[0][1]}, {KEYS[0]} bigint, {KEYS[1]} bigint, {KEYS[2]} string, n bigint, buckets array<bigint>")


def aligned(a: np.ndarray, b: np.ndarray) -> int:
    """Longest common subsequence of two sequences of distinct labels, with places at most as far apart as THRESHOLD allows."""
    n1, n2 = len(a), len(b)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    most = (n1 + n2) * (1 - THRESHOLD) / (1 + THRESHOLD)
    near = np.abs(i - j) <= most
    j = j[near][np.argsort(i[near])]
    if len(j) < 2 or (j[1:] > j[:-1]).all():
        return len(j)
    ends: list[int] = []
    for x in j.tolist():
        at = bisect_left(ends, x)
        if at == len(ends):
            ends.append(x)
        else:
            ends[at] = x
    return len(ends)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    common = aligned(a, b)
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def _labels(packed: bytes) -> np.ndarray:
    h = np.frombuffer(packed, np.uint32).astype(np.uint64)
    shingles, first = rolled(h, np.array([0, len(h)]))
    return labelled(shingles, first)


def packed_words(texts: DataFrame) -> DataFrame:
    """(id, w): the words of each text as 32-bit hashes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column("text"))
            h = (words.hashes >> _U(32)).astype(np.uint32)
            packed = [h[a:b].tobytes() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "w": pa.array(packed, pa.binary())})

    return texts.select("id", "text").mapInArrow(task, "id bigint, w binary")


def hot_keys(sizes: DataFrame, keys: list[str], total: int) -> DataFrame:
    """(keys, __parts) of the keys that ``sizes`` (keys, size) of a table of ``total`` rows shows to be hot: MOST_HOT at most."""
    limit = max(HOT, -(-total // MOST_HOT))
    return sizes.where(F.col("size") > limit).select(*keys, F.ceil(F.col("size") / limit).cast("int").alias("__parts"))


def salted(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """The join of ``left`` with ``right``, one row a key, where rows of a ``hot`` key go to as many tasks as it has parts.

    The right rows of hot keys are copied once a part, which adds fewer rows than left has / HOT * 2. ``hot`` is broadcast. The part
    hangs on a left row's first other column and its place among the tasks, so that repeated rows are split too.
    """
    other = next(c for c in left.columns if c not in keys)
    part = F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(other, F.spark_partition_id()), "__parts")).cast("int")
    spread = F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))
    many, once = (df.join(F.broadcast(hot), keys, "left").withColumn("__part", c).drop("__parts") for df, c in ((left, part), (right, spread)))
    return many.join(once, [*keys, "__part"]).drop("__part")


def compared(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """``pairs`` (x, y) of text ids, written ones, with ``linked``. A leader's pairs are split over tasks, as its text is in all."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, labels = None, None
        for batch in batches:
            out = []
            for a, b in zip(batch.column("wx"), batch.column("wy"), strict=True):
                a, b = a.as_py(), b.as_py()
                if b != last:  # a leader's pairs often come in runs
                    last, labels = b, _labels(b)
                out.append(similarity(_labels(a), labels) >= THRESHOLD)
            yield pa.RecordBatch.from_pydict({"x": batch.column("x"), "y": batch.column("y"), "linked": pa.array(out, pa.bool_())})

    sides = [words.select(F.col("id").alias(c), F.col("w").alias("w" + c)) for c in "xy"]
    hot = hot_keys(pairs.groupBy("y").agg(F.count("*").alias("size")), ["y"], pairs.count())
    both = salted(pairs.join(sides[0], "x"), sides[1], ["y"], hot)  # an x has a pair a bucket, or FEW of them
    return both.select("x", "y", "wx", "wy").mapInArrow(task, "x bigint, y bigint, linked boolean")


def components(links: DataFrame) -> DataFrame:
    """(key, c): the smallest key that a key is connected with by ``links`` (x, y); keys without links are not in it.

    Each step hangs all neighbours of a key, and itself, on the smallest among them, by turns for larger and for smaller
    neighbours, until nothing changes (Kiveris et al., 2014); groups meet as partial minima only, and their edges in parts.
    """

    def hung(rows: DataFrame, low: DataFrame, total: int) -> DataFrame:
        """(u, v): what ``rows`` (u, v) have as v, hung on the least of u."""
        hot = hot_keys(rows.groupBy("u").agg(F.count("*").alias("size")), ["u"], total)
        return salted(rows, low, ["u"], hot).select(F.col("v").alias("u"), F.col("m").alias("v"))

    edges = written(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u != v").distinct())
    while True:
        before = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = written(hung(both.where("v > u"), low, before[0]))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = hung(large, low, before[0]).unionByName(low.withColumnRenamed("m", "v")).where("u != v")
        edges = written(small.distinct())
        if edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first() == before:
            return edges.select(F.col("u").alias("key"), F.col("v").alias("c"))


def _classed(members: DataFrame, classes: DataFrame) -> DataFrame:
    """``members`` (id, bucket, n) with their class c; a text without links is its own."""
    return members.join(classes.withColumnRenamed("key", "id"), "id", "left").withColumn("c", F.coalesce("c", "id"))


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def linked_texts(members: DataFrame, hot: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs (x, y) of texts in crowded buckets (id, n, bucket), some ``hot``, that connect every class, by links that were verified."""
    links: list[DataFrame] = []
    tested: list[DataFrame] = []

    def test(pairs: DataFrame) -> None:
        if tested:
            pairs = pairs.join(_all(tested).select("x", "y"), ["x", "y"], "left_anti")
        tested.append(written(compared(written(pairs), words)))
        links.append(tested[-1].where("linked").select("x", "y"))

    lead = members.groupBy("bucket").agg(F.min("id").alias("y"))
    test(salted(members, lead, ["bucket"], hot).where("id != y").select(F.col("id").alias("x"), "y").distinct())
    first = components(links[0])
    now = _classed(members, first)
    open_ = now.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("size")).where("low != high").select("bucket", "size")
    now = written(salted(now, open_, ["bucket"], hot))
    few = now.where(F.col("size") <= FEW)
    x, y = (few.select("bucket", *(F.col(c).alias(c + side) for c in ("id", "n", "c"))) for side in "xy")
    fits = (F.col("nx") >= F.lit(THRESHOLD) * F.col("ny")) & (F.col("ny") >= F.lit(THRESHOLD) * F.col("nx"))
    test(x.join(y, "bucket").where((F.col("idx") > F.col("idy")) & (F.col("cx") != F.col("cy")) & fits).select(F.col("idx").alias("x"), F.col("idy").alias("y")).distinct())
    links.append(written(tiled(now.where(F.col("size") > FEW), words)))
    return _all([first.select(F.col("key").alias("x"), F.col("c").alias("y")), *links[1:]])


def tiled(members: DataFrame, words: DataFrame) -> DataFrame:
    """Links (x, y) that join the classes of large buckets (id, c, bucket, size), each pair of texts looked at.

    A bucket's texts are dealt to blocks of about BLOCK; a task gets two blocks (or one twice), so a text goes to as many tasks
    as its bucket has blocks, and no pairs are made but in the task's arrays.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = members.withColumn("block", F.pmod(F.xxhash64("id", F.lit(8)), blocks).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tiles = own.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "c")
    whole = tiles.join(words, "id").select("bucket", "i", "j", "block", "id", "c", "w")

    def look(tile: pa.Table) -> pa.Table:
        return pa.Table.from_pydict(dict(zip("xy", (pa.array(v, pa.int64()) for v in _forest(tile)), strict=True)))

    return whole.groupBy("bucket", "i", "j").applyInArrow(look, "x bigint, y bigint").distinct()


def _forest(tile: pa.Table) -> tuple[list[int], list[int]]:
    """Links between texts of a tile that join its classes: one for each joining."""
    ids, classes, block = (tile.column(c).to_numpy() for c in ("id", "c", "block"))
    own = [_labels(w) for w in tile.column("w").to_pylist()]
    n, size = len(own), np.array([len(x) for x in own])
    row = np.repeat(np.arange(n), size)
    _, which, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1  # labels of one text alone meet nothing
    shared = np.flatnonzero(times[which] > 1)
    row, at = row[shared], column[which[shared]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    common = np.zeros((n, n), np.float32)
    for a in range(0, int((times > 1).sum()), COLUMNS):
        low, high = np.searchsorted(at, [a, a + COLUMNS])
        part = np.zeros((n, COLUMNS), np.float32)
        part[row[low:high], at[low:high] - a] = 1
        common += part @ part.T
    # no alignment has more than the common labels
    may = common >= THRESHOLD * (size[:, None] + size[None, :] - common)
    if block.min() != block.max():
        may &= block[:, None] != block[None, :]
    x, y = np.nonzero(np.triu(may, 1) & (classes[:, None] != classes[None, :]))
    root = {c: c for c in classes.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out: tuple[list[int], list[int]] = ([], [])
    for p, q in zip(x.tolist(), y.tolist(), strict=True):
        a, b = find(int(classes[p])), find(int(classes[q]))
        if a != b and similarity(own[p], own[q]) >= THRESHOLD:
            root[a] = b
            out[0].append(int(ids[p]))
            out[1].append(int(ids[q]))
    return out


def classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` (doc_id, KEYS), and their distinct texts: (KEYS[:2], copies, least, c), c the class."""
    rows = written(sketched(docs))
    texts = rows.groupBy(*KEYS[:2]).agg(F.min("doc_id").alias("least"), F.min(KEYS[2]).alias(KEYS[2]), F.count("*").alias("copies"), F.min("n").alias("n"), F.min("buckets").alias("buckets"))
    texts = written(texts.withColumn("id", F.monotonically_increasing_id()))
    members = texts.where("n > 0").select("id", "n", F.explode("buckets").alias("bucket"))
    crowded = written(members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    hot = hot_keys(crowded, ["bucket"], crowded.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    members = written(salted(members, crowded.select("bucket"), ["bucket"], hot))
    wanted = texts.select("id", *KEYS).join(members.select("id").distinct(), "id")
    words = written(packed_words(keyed(docs.select("doc_id", "text")).join(wanted, KEYS).dropDuplicates(["id"])))
    joined = components(linked_texts(members, hot, words)).withColumnRenamed("key", "id")
    return rows, texts.select(*KEYS[:2], "id", "copies", "least").join(joined, "id", "left").withColumn("c", F.coalesce("c", "id"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, copies) of each row: copies is the number of rows with the same text."""
    rows, texts = classified(docs)
    texts, total = written(texts), rows.count()
    named = texts.groupBy("c").agg(F.min("least").alias("class_id"))
    large = hot_keys(texts.groupBy("c").agg(F.count("*").alias("size")), ["c"], total)
    named = salted(texts.select("c", *KEYS[:2], "copies"), named, ["c"], large).select(*KEYS[:2], "class_id", "copies")
    often = hot_keys(texts.groupBy(*KEYS[:2]).agg(F.sum("copies").alias("size")), KEYS[:2], total)
    return salted(rows.select(*KEYS[:2], "doc_id"), named, KEYS[:2], often).select("doc_id", "class_id", "copies")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each class, that with the smallest doc_id (null: last); of equal ids and texts, any one. All columns stay."""
    _, texts = classified(docs)
    first = texts.groupBy("c").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "id")).alias("m")).select("m.id")
    kept = texts.join(first, "id").select(*KEYS[:2], F.coalesce(F.col("least").cast("string"), F.lit("")).alias(KEYS[2]))
    return keyed(docs).join(kept, KEYS).dropDuplicates(KEYS).select(*docs.columns)
