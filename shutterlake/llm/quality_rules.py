"""Quality rules: counts over whole texts and a calibrated classifier against a fixed threshold.

The classifier is a logistic regression over hashed word and character n-grams (``linear.Grams``), trained on labelled quality
rows by averaged AdaGrad rounds. A fold of the labelled rows is kept from training; on it the score's scale and offset are
fitted (Platt), from counts by score bin, so that it is a probability. Texts are scored in Arrow batches. A document stays if
no count fails and its probability of good quality is THRESHOLD at least.

Defined results: a null or empty text has counts 0, fails the base rules and scores as an empty text; with no
labelled rows every probability is 0.5; rows repeated or without id are scored each; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import Words, mixed, scratch, slices
from shutterlake.llm.linear import MAX_ROWS, ROWS_A_SLICE, WIDTH, Grams, by_shard, examples, sigmoid, summed, valued

THRESHOLD = 0.3
CALIBRATION_FOLDS = 5
ROUNDS, RATE, BATCH = 3, 0.5, 32
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CONTINUES = np.array([0x80 <= b < 0xC0 for b in range(256)])


def counts(words: Words) -> dict[str, np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    rows = len(words.first) - 1
    data = words.data
    inner = np.zeros(len(data) + 1, np.int64)
    inner[words.starts] += 1
    np.subtract.at(inner, words.ends, 1)
    in_word = np.cumsum(inner[:-1]).astype(bool)

    def summed(mark: np.ndarray) -> np.ndarray:
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(mark)])
        return at[words.offsets[1:]] - at[words.offsets[:-1]]

    row, h = words.text_of, words.hashes
    repeated = np.zeros(len(h), bool)
    if len(h) > 2:
        inside = np.flatnonzero(row[:-2] == row[2:])
        window = mixed(mixed(h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(5) + h[2:])[inside]
        window = mixed(window ^ row[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, which, n = np.unique(window, return_inverse=True, return_counts=True)
        for k in range(3):
            repeated[inside[n[which] > 1] + k] = True
    return {"n_words": words.counts, "word_chars": summed(in_word & ~_CONTINUES[data]), "n_symbols": summed(_SYMBOL[data]), "n_dup_lines": _dup_lines(words), "n_repeat_words": np.bincount(row[repeated], minlength=rows)}


def _dup_lines(words: Words) -> np.ndarray:
    """Lines with a word that are equal, byte by byte, to an earlier line of their text."""
    out = np.zeros(len(words.first) - 1, np.int64)
    for i, (a, b) in enumerate(zip(words.offsets[:-1], words.offsets[1:], strict=True)):
        lines = words.data[a:b].tobytes().split(b"\n")
        if len(lines) > 1:
            lines = [x for x in lines if x.strip(b" \t\n\x0b\x0c\r")]
            out[i] = len(lines) - len(set(lines))
    return out


def learned(batches: Iterator[pa.RecordBatch], w: np.ndarray) -> tuple[np.ndarray, int]:
    """Weights after one shard's rows in small batches, with rates from summed squares of derivatives; and the number of rows."""
    w, squares, rows = w.copy(), np.full(WIDTH, 1e-8), 0
    for batch in slices(batches, rows=ROWS_A_SLICE):
        x = Grams(Words(batch.column("text"), exact=True))
        y, weight = np.array(batch.column("y"), float), np.array(batch.column("weight"), float)
        for a in range(0, x.rows, BATCH):
            b = min(a + BATCH, x.rows)
            g = x.gradient((sigmoid(x.logits(w, a, b)) - y[a:b]) * weight[a:b] / (b - a), a, b)
            squares += g * g
            w -= RATE * g / np.sqrt(squares)
        rows += x.rows
    return w, rows


def fit(rows: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, float, float]:
    """(weights, scale, offset) from examples (shard, text, y), written; each class counts half."""
    held = F.pmod(F.xxhash64("text", F.lit(41)), F.lit(CALIBRATION_FOLDS)) == 0
    total, good = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < good < total:
        p = (good + 1) / (total + 2)
        return np.zeros(WIDTH), 0.0, float(np.log(p / (1 - p)))
    weight = F.when(F.col("y") == 1, F.lit(total / (2 * good))).otherwise(F.lit(total / (2 * (total - good))))
    own, weights = rows.where(~held).withColumn("weight", weight), np.zeros(WIDTH)
    for _ in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast(weights)

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> np.ndarray | None:
            total = np.zeros(WIDTH + 1)
            for _, part in by_shard(batches):
                w, n = learned(part, sent.value)
                total[:-1] += n * w
                total[-1] += n
            return total

        got = summed(own, work, WIDTH + 1)
        weights = got[:-1] / got[-1] if got[-1] else weights
        sent.destroy()
    bins = F.floor(F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("value"))) * 25).alias("bin")
    got = valued(rows.where(held).select("y", "text"), weights).groupBy(bins).agg(F.count("*").alias("n"), F.sum("y").alias("good")).collect()  # at most 2,001 rows
    return weights, *platt(np.array([(r["bin"] + 0.5) / 25 for r in got]), np.array([r["n"] for r in got], float), np.array([r["good"] for r in got], float))


def platt(x: np.ndarray, n: np.ndarray, good: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Scale and offset of the logistic curve through good / n at x, by Newton steps with a weak pull to (1, 0)."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * x + b)
        r, v = n * p - good, n * p * (1 - p)
        g = np.array([(r * x).sum() + 0.1 * (a - 1), r.sum() + 0.1 * b])
        h = np.array([[(v * x * x).sum() + 0.1, (v * x).sum()], [(v * x).sum(), v.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return float(a), float(b)


def judged(docs: DataFrame, model: tuple[np.ndarray, float, float], threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, the counts, base_failed, quality (probability) and kept."""
    weights, scale, offset = model
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=ROWS_A_SLICE):
            words = Words(batch.column("text"), exact=True)
            own = counts(words)
            failed = (own["n_words"] < 50) | (100 * own["n_repeat_words"] > 50 * own["n_words"])
            p = sigmoid(scale * Grams(words).logits(sent.value) + offset)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {k: pa.array(v, pa.int64()) for k, v in own.items()} | {"base_failed": pa.array(failed), "quality": pa.array(p), "kept": pa.array(~failed & (p >= threshold))})

    own = docs.select("doc_id", "text")
    return own.mapInArrow(task, f"doc_id {own.dtypes[0][1]}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, quality double, kept boolean")


def rules(docs: DataFrame, labels: DataFrame, bound: int = MAX_ROWS) -> DataFrame:
    with scratch(examples(docs, labels, "quality", F.lit(True), bound)) as rows:
        model = fit(rows)
    return judged(docs, model)
