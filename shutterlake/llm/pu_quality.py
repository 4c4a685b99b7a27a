"""Quality by positive-unlabelled learning: the non-negative unbiased risk over trusted positives and unlabelled web text.

Trusted positives (P) are rows labelled good, a bounded sample (MAX_ROWS by hash of doc_id). The unlabelled text (U) is all web
text that may be learned from, whatever labels it has, so that U has the mix of good and bad that is to be told apart; ``bound``
None takes all of it. Labels of bad rows have no part. With class prior pi and the logistic loss the risk is
pi R_P(+) + max(0, R_U(-) - pi R_P(-)) (Kiryo et al., 2017): a batch whose second term is below zero has no part in it, which
keeps a flexible model from fitting P as all that is good. Every batch of U is in the risk, however rare P is: each shard also
gets SPARE rows of P (all rows of P in turn over the shards), which stand for P in batches with fewer than OWN of their own.

pi is estimated from P and U alone. The first round learns to tell P from U. On a fold that is kept from all learning, the share
of U above any cut of that score is at least pi times the share of P above it, so pi is at most their ratio; the least ratio
over cuts with TAIL of P above them, less its standard error, is the estimate. The other rounds (ROUNDS) go down the risk. At last scale and offset of the
values are set to where the risk over that fold is least: with the logistic loss it is pi E_P[-z] + E_U[log(1 + exp z)], convex
in both, from numbers of rows by bin. Inputs: ``linear.Grams``.

Defined results: a null or empty text scores by the bias and the cells of an empty text; with no positives or nothing unlabelled
every score is 0.5; rows repeated or without id are scored (and are unlabelled text) each; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.llm.common import Words, scratch, slices, written
from shutterlake.llm.linear import MAX_ROWS, ROWS_A_SLICE, WIDTH, Grams, by_shard, dealt, labelled, sampled, shards_for, sigmoid, summed, valued

ROUNDS, RATE = 2, 1.0
FOLDS, TAIL = 5, 0.5
BINS, SPAN = 1_000, 10.0
#: A batch with fewer rows of P than OWN takes the shard's SPARE ones.
SPARE, OWN = 32, 8
THRESHOLD = 0.3


def told_apart(p: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives by the values of rows of P and of U of the loss of P against U; both count the same."""
    return (sigmoid(p) - 1) / max(len(p), 1), sigmoid(u) / max(len(u), 1)


def non_negative(p: np.ndarray, u: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives by the values of rows of P and of U of the non-negative risk of one batch."""
    n = max(len(p), 1)
    if np.logaddexp(0, u).mean() - prior * (np.logaddexp(0, p).mean() if len(p) else 0) < 0:
        return prior * (sigmoid(p) - 1) / n, np.zeros(len(u))
    return np.full(len(p), -prior / n), sigmoid(u) / len(u)


def learned(batches: Iterator[pa.RecordBatch], w: np.ndarray, prior: float | None) -> tuple[np.ndarray, int]:
    """Weights after one shard's rows, in batches, with a rate for each weight from its squared derivatives; and the rows of U used."""
    w, squares, rows = w.copy(), np.full(WIDTH, 1e-8), 0
    spares: list[pa.Array] = []  # a shard begins with them
    reserve: Grams | None = None
    for batch in slices(batches, rows=ROWS_A_SLICE):
        texts, spare = batch.column("text"), np.array(batch.column("spare"), bool)
        if spare.any():
            spares.append(texts.filter(pa.array(spare)))
        own = np.flatnonzero(~spare)
        if not len(own):
            continue
        if spares:
            reserve, spares = Grams(Words(pa.concat_arrays(spares), exact=True)), []
        x, p = Grams(Words(texts.take(pa.array(own)), exact=True)), np.array(batch.column("positive"), bool)[own]
        z, more = x.logits(w), reserve if reserve and p.sum() < OWN else None
        at = np.concatenate([z[p], more.logits(w)]) if more else z[p]
        gp, gu = told_apart(at, z) if prior is None else non_negative(at, z, prior)
        gu[p] += gp[: p.sum()]
        g = x.gradient(gu, 0, x.rows)
        if more:
            g += more.gradient(gp[p.sum() :], 0, more.rows)
        squares += g * g
        w -= RATE * g / np.sqrt(squares)
        rows += x.rows
    return w, rows


def sample(docs: DataFrame, labels: DataFrame, allowed: Column, bound: int = MAX_ROWS, unlabelled: int | None = None) -> DataFrame:
    """(shard, text, positive, held, spare) of the text to learn from, to be written: U, of which the rows of P are marked, and the
    spare rows of P that each shard begins with.

    The ids of P are broadcast, about ``bound`` at most. ``unlabelled`` bounds U; None: all text for which ``allowed``.
    """
    own = labelled(labels, "quality", allowed, bound).where("y = 1").select("doc_id")
    u = sampled(docs.where(allowed).select("doc_id", "text"), F.col("doc_id"), unlabelled)
    held = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(FOLDS)) == 0, F.lit(False))
    there = u.select("doc_id").join(F.broadcast(own), "doc_id").distinct().withColumn("held", held)
    own = written(there.select("doc_id", "held", (F.row_number().over(Window.orderBy("held", F.xxhash64("doc_id", F.lit(43)), "doc_id")) - 1).alias("nth")))
    trusted = own.where("NOT held").count()
    rows = u.join(F.broadcast(own.drop("held")), "doc_id", "left").select("doc_id", "text", F.col("nth").isNotNull().alias("positive"), held.alias("held"), "nth")
    shards = shards_for(u.select("doc_id").count())
    # the spare rows of a shard s are those of P in the places SPARE s to SPARE (s + 1) - 1, counted round and round
    turns = F.sequence(F.lit(0), F.floor((SPARE * shards - 1 - F.col("nth")) / max(trusted, 1)).cast("int"))
    spare = rows.where("nth IS NOT NULL AND NOT held").where(F.col("nth") < SPARE * shards).withColumn("k", F.explode(turns))
    spare = spare.withColumn("to", F.floor((F.col("nth") + F.col("k") * max(trusted, 1)) / SPARE).cast("int"))
    each = rows.select("doc_id", "text", "positive", "held", F.lit(False).alias("spare"), F.lit(None).cast("int").alias("to"))
    return dealt(each.unionByName(spare.select("doc_id", "text", "positive", "held", F.lit(True).alias("spare"), "to")), shards)


def _round(rows: DataFrame, weights: np.ndarray, prior: float | None) -> np.ndarray:
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for _, part in by_shard(batches):
            w, n = learned(part, sent.value, prior)
            if n:
                total = np.zeros(WIDTH + 1) if total is None else total
                total[:-1] += n * w
                total[-1] += n
        return total

    got = summed(rows.where("NOT held").select("shard", "text", "positive", "spare"), work, WIDTH + 1)
    sent.destroy()
    return got[:-1] / got[-1] if got[-1] else weights


def prior_of(p: np.ndarray, u: np.ndarray) -> float:
    """The class prior from numbers of rows of P and U by score bin, lowest first."""
    above_p, above_u = np.cumsum(p[::-1]), np.cumsum(u[::-1])
    cuts = above_p >= max(1, TAIL * above_p[-1])
    if not above_p[-1] or not above_u[-1]:
        return 0.5
    least = min(1.0, np.min(above_u[cuts] / above_u[-1] / (above_p[cuts] / above_p[-1])))
    return float(np.clip(least - np.sqrt(least * (1 - least) / above_p[-1]), 0.01, 0.99))


def binned(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of held rows of P and of U by bin of their values."""
    bin_ = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("value") + SPAN) * (BINS / (2 * SPAN)))))
    got = valued(rows.where("held AND NOT spare").select("positive", "text"), weights).groupBy(bin_.alias("bin")).agg(F.count_if("positive").alias("p"), F.count("*").alias("u")).collect()  # at most BINS rows
    p, u = np.zeros(BINS), np.zeros(BINS)
    for r in got:
        p[r["bin"]], u[r["bin"]] = r["p"], r["u"]
    return p, u


def calibrated(p: np.ndarray, u: np.ndarray, prior: float, pull: float = 1e-3, steps: int = 60) -> tuple[float, float]:
    """Scale and offset of values with the least risk, by Newton steps with a weak pull to (1, 0)."""
    a, b = 1.0, 0.0
    if not p.sum() or not u.sum():
        return a, b
    x = (np.arange(BINS) + 0.5) * (2 * SPAN / BINS) - SPAN
    p, u = p / p.sum(), u / u.sum()
    for _ in range(steps):
        h = sigmoid(a * x + b)
        r, v = u * h - prior * p, u * h * (1 - h)
        g = np.array([(r * x).sum() + pull * (a - 1), r.sum() + pull * b])
        m = np.array([[(v * x * x).sum() + pull, (v * x).sum()], [(v * x).sum(), v.sum() + pull]])
        a, b = np.array([a, b]) - np.linalg.solve(m, g).clip(-1, 1)
    return max(float(a), 0.0), float(b)


def fit(rows: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(weights, class prior) from what ``sample`` gives, written."""
    if rows.where("spare").isEmpty():  # no positives
        return np.zeros(WIDTH), 0.5
    weights = _round(rows, np.zeros(WIDTH), None)
    prior = prior_of(*binned(rows, weights))
    for _ in range(rounds):
        weights = _round(rows, weights, prior)
    scale, offset = calibrated(*binned(rows, weights), prior)
    weights = scale * weights
    weights[-1] += offset
    return weights, prior


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of each row: the probability that its text is good."""
    return valued(docs.select("doc_id", "text"), weights).select("doc_id", (1 / (1 + F.exp(-F.col("value")))).alias("score"))


def trained(docs: DataFrame, labels: DataFrame, allowed: Column, bound: int = MAX_ROWS, unlabelled: int | None = None) -> tuple[np.ndarray, float]:
    """(weights, class prior)."""
    with scratch(sample(docs, labels, allowed, bound, unlabelled)) as rows:
        return fit(rows)
