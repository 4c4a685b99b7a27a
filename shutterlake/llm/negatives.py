"""Hard negatives of anchors by distributed radix selection over integer scores.

Rows become vectors of integers, floor(256 x), written once. Anchors are a stated share of the rows and meet all rows in blocks of
ANCHORS: tasks get a block and find its scores with their rows as matrix products, exact in float32, float64 or int64 as the
largest norm allows. Nothing but counts and a few rows leaves a task:

- A window is an interval of scores from which the k best rows are wanted: for positives all scores of an anchor's label, for
  negatives the share of a positive's score that makes a row of another label hard. A round counts a window's scores by digit,
  from the top, in tasks; a task sends no more digits than reach k rows, since the kth best of all is not below its own. Spark
  adds up, the digit where the sum reaches k becomes the window, and rounds go on until it is one score.
- Then only rows at or above that score are gathered, of each task the k first by (score, id), so ties of one score, however
  many, do not pile up.

What the driver sees of a block is a few numbers for each anchor. Rounds depend on the largest norm only (two for unit vectors).
Results of a block are written, so a block is not done again when executors are lost.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part; vectors of other lengths
than the anchor's have no score with it; rows that share an id with the anchor are not its positives, and of anchors that share
an id the least by (label, vector) is one; else rows repeated take places of their own; ties go by the smaller id; an empty
table gives no rows; extra columns are not read. A score must fit a long: norms beyond that raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.llm.common import work_dir, written

ANCHORS = 4_096
DIGIT = 9
CELLS = 1 << 22
POSITIVES, NEGATIVES, LOW, HIGH, EVERY = 5, 3, 50, 95, 50


def prepared(rows: DataFrame) -> DataFrame:
    """(vec_id, label, q) of the rows that take part; q: the components as integers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    fit = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(F.forall("embedding", lambda x: F.coalesce(finite(x.cast("double")), F.lit(False))))
    return fit.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("bigint")).alias("q"))


class Block:
    """Anchors: ids, labels, and by length of vector their places and matrix."""

    def __init__(self, got: pa.Table, kind: type):
        self.ids, self.labels = got.column("vec_id").to_numpy(), got.column("label").to_numpy()
        self.by_size = dict(vectors(got.column("q").combine_chunks(), kind))


def vectors(q: pa.ListArray, kind: type) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """(length, (rows, matrix)) of the vectors of each length."""
    sizes, first = q.value_lengths().to_numpy(), q.offsets.to_numpy()
    flat = q.values.to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield int(size), (rows, flat[first[rows][:, None] + np.arange(size)[None, :]].astype(kind))


class Windows:
    """Intervals [low, high] of scores, ``k`` rows wanted of each; arrays of (anchors, windows of an anchor). An empty one has low > high."""

    def __init__(self, low: np.ndarray, high: np.ndarray, need: np.ndarray, same: bool):
        self.low, self.high, self.need, self.same = low, high, need, same


def scored(batches: Iterator[pa.RecordBatch], block: Block, windows: Windows, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, score, id) of the rows that fall into windows, a part of a batch at a time."""
    least, most = windows.low.min(axis=1), windows.high.max(axis=1)
    live = (windows.low <= windows.high).any(axis=1)
    for batch in batches:
        ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
        for size, (rows, matrix) in vectors(batch.column("q"), kind):
            at, own = block.by_size.get(size, (None, None))
            if at is None or not live[at].any():
                continue
            for r, m, a, v in _products(rows, labels, matrix, at[live[at]], block.labels, own[live[at]], windows.same):
                s = m @ v.T
                fits = (s >= least[a]) & (s <= most[a])
                fits &= (ids[r][:, None] != block.ids[a]) if windows.same else (labels[r][:, None] != block.labels[a])
                x, y = np.nonzero(fits)
                score, anchor, found = s[x, y].astype(np.int64), a[y], ids[r[x]]
                for k in range(windows.low.shape[1]):
                    inside = (score >= windows.low[anchor, k]) & (score <= windows.high[anchor, k])
                    yield anchor[inside] * windows.low.shape[1] + k, score[inside], found[inside]


def _products(rows: np.ndarray, labels: np.ndarray, matrix: np.ndarray, at: np.ndarray, anchor_labels: np.ndarray, own: np.ndarray, same: bool) -> Iterator[tuple]:
    """Rows and anchors to multiply: all of them, or label by label, in parts of about CELLS products."""
    if same:
        groups = [(np.flatnonzero(labels[rows] == x), np.flatnonzero(anchor_labels[at] == x)) for x in np.intersect1d(labels[rows], anchor_labels[at])]
    else:
        groups = [(np.arange(len(rows)), np.arange(len(at)))]
    for r, a in groups:
        step = max(1, CELLS // len(a))
        for i in range(0, len(r), step):
            part = r[i : i + step]
            yield rows[part], matrix[part], at[a], own[a]


def _digits(rows: DataFrame, block: Broadcast, windows: Windows, shift: int, kind: type) -> list[tuple[int, int, int]]:
    """(window, digit, rows of higher digits) where the rows counted from the top reach what the window needs."""
    sent = rows.sparkSession.sparkContext.broadcast(windows)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        high, need = w.high.ravel(), w.need.ravel()
        counts = np.zeros((len(high), 1 << DIGIT), np.int32)
        for window, score, _ in scored(batches, block.value, w, kind):
            np.add.at(counts, (window, (high[window] - score) >> shift), 1)
        above = np.cumsum(counts, axis=1) - counts
        i, d = np.nonzero((counts > 0) & (above < need[:, None]))
        if len(i):
            yield pa.RecordBatch.from_pydict({"w": pa.array(i), "d": pa.array(d), "n": pa.array(counts[i, d].astype(np.int64)), "need": pa.array(need[i].astype(np.int64))})

    sums = rows.mapInArrow(task, "w bigint, d bigint, n bigint, need bigint").groupBy("w", "d").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
    upto = F.sum("n").over(Window.partitionBy("w").orderBy("d"))
    got = sums.select("w", "d", "need", (upto - F.col("n")).alias("above"), upto.alias("upto")).where("above < need AND need <= upto").select("w", "d", "above").toArrow()  # a row a window at most
    sent.destroy()
    return list(zip(*(got.column(c).to_pylist() for c in ("w", "d", "above")), strict=True))


def selected(rows: DataFrame, block: Broadcast, windows: Windows, k: int, kind: type) -> DataFrame:
    """(w, rank, score, id): the k best rows of each window, fewer where it has fewer."""
    shape = windows.low.shape
    low, high, need = windows.low.ravel().copy(), windows.high.ravel().copy(), windows.need.ravel().copy()
    least = low.copy()  # where fewer than k rows are inside, all are wanted
    bits = int(np.maximum(high - low + 1, 1).max(initial=1) - 1).bit_length()
    shift = max(0, bits - DIGIT)
    while (low <= high).any():
        found = _digits(rows, block, Windows(low.reshape(shape), high.reshape(shape), need.reshape(shape), windows.same), shift, kind)
        open_ = np.zeros(len(low), bool)
        for w, d, above in found:
            top = high[w] - (d << shift)
            low[w], high[w], need[w] = max(low[w], top - (1 << shift) + 1), top, need[w] - above
            least[w], open_[w] = low[w], shift > 0 and low[w] < top
        low[~open_], high[~open_] = 1, 0
        shift = max(0, shift - DIGIT)
    sent = rows.sparkSession.sparkContext.broadcast(Windows(least.reshape(shape), windows.high, windows.need, windows.same))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = tuple(np.zeros(0, np.int64) for _ in range(3))
        waiting, size = [], 0

        def first(parts: list[tuple]) -> tuple:
            w, s, i = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((i, -s, w))
            w, s, i = w[order], s[order], i[order]
            begins = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, np.int64)
            stay = np.arange(len(w)) - np.repeat(begins, np.diff(np.append(begins, len(w)))) < k
            return w[stay], s[stay], i[stay]

        for part in scored(batches, block.value, sent.value, kind):
            waiting.append(part)
            size += len(part[0])
            if size > CELLS // 4:
                best, waiting, size = first([best, *waiting]), [], 0
        w, s, i = first([best, *waiting])
        if len(w):
            yield pa.RecordBatch.from_pydict({"w": pa.array(w), "score": pa.array(s), "id": pa.array(i)})

    near = rows.mapInArrow(task, "w bigint, score bigint, id bigint")
    rank = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), "id"))
    return near.select("w", rank.alias("rank"), "score", "id").where(F.col("rank") <= k)


def _kind(norm: float) -> type:
    """In which numbers a product is exact, as no sum of absolute products is beyond the largest squared norm."""
    if norm >= 2.0**62:
        raise ValueError("scores of these vectors don't fit a long")
    return np.float32 if norm < 2**24 else np.float64 if norm < 2**53 else np.int64


def mined(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows (vec_id, label, embedding).

    For each of the first ``positives`` rows of an anchor's label, the first ``negatives`` rows of other labels whose score is
    ``low`` to ``high`` percent of the positive's.
    """
    spark = rows.sparkSession
    rows = written(prepared(rows))
    square = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    norm, n = rows.agg(F.coalesce(F.max(square), F.lit(0.0)), F.count_if(anchor)).first()
    kind, bound = _kind(norm), int(norm) + 1
    chosen = rows.where(anchor).groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("o")).select("vec_id", "o.label", "o.q")
    blocks = max(1, -(-n // ANCHORS))
    folder, out = work_dir(spark), work_dir(spark)
    chosen.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).write.partitionBy("block").parquet(folder)
    result = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    spark.createDataFrame([], result).write.parquet(out)
    if not n:
        return spark.read.schema(result).parquet(out)
    for b in range(blocks):
        got = spark.read.schema("vec_id bigint, label bigint, q array<bigint>, block int").parquet(folder).where(F.col("block") == b).toArrow()  # ANCHORS rows or so
        if not got.num_rows:
            continue
        block = spark.sparkContext.broadcast(Block(got, kind))
        size = got.num_rows
        whole = Windows(np.full((size, 1), -bound), np.full((size, 1), bound), np.full((size, 1), positives), True)
        found = selected(rows, block, whole, positives, kind).toArrow()  # ``positives`` rows an anchor
        at, score, id_, rank = (found.column(c).to_numpy() for c in ("w", "score", "id", "rank"))
        lows, highs = np.ones((size, positives), np.int64), np.zeros((size, positives), np.int64)
        tens, ones = np.divmod(score, 100)  # so that no product leaves a long
        lows[at, rank - 1], highs[at, rank - 1] = low * tens - (-low * ones // 100), high * tens + high * ones // 100
        windows = Windows(lows, highs, np.full((size, positives), negatives), False)
        hard = selected(rows, block, windows, negatives, kind)
        given = spark.createDataFrame(pa.Table.from_pydict({"w": pa.array(at * positives + rank - 1), "anchor_id": pa.array(block.value.ids[at]), "positive_id": pa.array(id_), "positive_score": pa.array(score)}))
        pairs = hard.join(given, "w").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        pairs.write.mode("append").parquet(out)
        block.destroy()
    return spark.read.schema(result).parquet(out)


def relabelled(rows: DataFrame) -> DataFrame:
    """The labels of op12: where the id is divisible by 7, the next of ten."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank,
  s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
