"""Term index, BM25 and the fusion of recall channels."""

from __future__ import annotations

from functools import cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shutterlake.sources.shared import kept

#: Weights of the fields, and of a term by its length.
FIELD_WEIGHTS = {"description": 200, "keywords": 180, "subject_tags": 170, "action_tags": 120, "scene_tags": 100}
OTHER_FIELD, SHORT_TERM, LONG_TERM, OCR_HIT, VECTOR = 40, 16, 40, 85, 120
K1, B = 1.2, 0.75
CJK = "[㐀-鿿]+"


def latin_terms(text: Column) -> Column:
    """Distinct lower-case words of two ASCII letters or more, and runs of digits."""
    return F.array_distinct(F.concat(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{2,}"), F.lit(0)), F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))))


def cjk_terms(text: Column) -> Column:
    """Single characters and pairs of each run of Chinese characters."""
    grams = lambda run, n: F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: run.substr(i, F.lit(n)))
    own = lambda run: F.when(F.length(run) > 1, F.concat(grams(run, 1), grams(run, 2))).otherwise(F.array(run))
    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(CJK), F.lit(0)), own)))


def terms(text: Column) -> Column:
    return F.array_union(cjk_terms(text), latin_terms(text))


def term_index(docs: DataFrame, fields: dict[str, str], wanted: list[str] | None = None) -> DataFrame:
    """(media_id, field, term) of columns by field name; of ``wanted`` terms only, if given, before any row is made of them."""
    some = lambda t: F.array_intersect(t, F.array(*map(F.lit, wanted))) if wanted is not None else t
    own = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), some(terms(F.coalesce(F.col(c), F.lit("")))).alias("terms")) for f, c in fields.items()))).alias("f")
    return docs.select("media_id", own).select("media_id", F.col("f.field").alias("field"), F.explode("f.terms").alias("term"))


def term_recall(index: DataFrame, wanted: list[str]) -> DataFrame:
    """(media_id, score, hits): the sum over met (field, term) of the field's weight and the term's boost."""
    weight = F.coalesce(F.create_map(*(F.lit(x) for kv in FIELD_WEIGHTS.items() for x in kv))[F.col("field")], F.lit(OTHER_FIELD))
    boost = F.when(F.length("term") >= 2, LONG_TERM).otherwise(SHORT_TERM)
    return index.where(F.col("term").isin(wanted)).groupBy("media_id").agg(F.sum(weight + boost).alias("score"), F.count_distinct("term").alias("hits"))


LETTER = r"[\p{L}\p{N}]"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(LETTER + "+"), F.lit(0))


@cache
def token_letters(spark: SparkSession) -> np.ndarray:
    """The characters of tokens as Spark's patterns tell them, for tasks that cut texts themselves: code points from, to (not in it)."""
    code = spark.range(0x110000).where("id NOT BETWEEN 55296 AND 57343")
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    own = code.where(char.rlike(LETTER)).orderBy("id").toArrow().column("id").to_numpy()  # of all characters, not of the data
    at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1] + 1]))
    return np.stack([own[at], own[np.append(at[1:], len(own)) - 1] + 1], axis=1)


def bm25(docs: DataFrame, fields: dict[str, float], wanted: list[str]) -> DataFrame:
    """(media_id, score) of rows that have all ``wanted`` tokens in some field; fields with their weights.

    Rows become lengths and counts of the wanted tokens at once, so no postings of other tokens are made.
    """
    own = [(w, tokens(F.coalesce(F.col(c), F.lit("")))) for c, w in fields.items()]
    size = reduce(Column.__add__, (F.size(t) for _, t in own))
    count = lambda t, q: F.size(F.filter(t, lambda x: x == F.lit(q)))
    tf = [reduce(Column.__add__, (F.lit(float(w)) * count(t, q) for w, t in own)) for q in wanted]
    rows = docs.select("media_id", size.alias("d"), *(c.alias(f"f{i}") for i, c in enumerate(tf)))
    stats = rows.agg(F.count("*").alias("n_rows"), F.avg("d").alias("avg_d"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(wanted))))
    idf = lambda i: F.when((v := F.log((F.col("n_rows") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))) > 0, v).otherwise(1e-6)
    part = lambda i: idf(i) * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + K1 * (1 - B + B * F.col("d") / F.col("avg_d")))
    hit = rows.where(reduce(Column.__and__, (F.col(f"f{i}") > 0 for i in range(len(wanted)))))
    return hit.join(F.broadcast(stats)).select("media_id", reduce(Column.__add__, (part(i) for i in range(len(wanted)))).alias("score"))  # stats: one row


def fused(channels: dict[str, DataFrame]) -> DataFrame:
    """Channels (media_id, score) by name as one list: summed scores, and a flag for each channel; OCR with vector first."""
    union = reduce(DataFrame.unionByName, (df.select("media_id", F.col("score").cast("double").alias("score"), F.lit(name).alias("channel")) for name, df in channels.items()))
    got = union.groupBy("media_id").agg(F.round(F.sum("score"), 6).alias("score"), *(F.max((F.col("channel") == c).cast("int")).alias(c) for c in channels))
    flag = lambda c: F.col(c) == 1 if c in channels else F.lit(False)
    return got.withColumn("tier", F.when(flag("ocr") & flag("vector"), 3).when(flag("ocr"), 2).when(flag("vector"), 1).otherwise(0))


def position_scores(ranked: DataFrame, base: int = 28, least: int = 6) -> DataFrame:
    """(media_id, score) from places in the order of falling BM25, ties by id. Only the first base - least places differ, so only
    so many rows are put in order; they are broadcast."""
    order = [F.round("score", 9).desc(), F.col("media_id")]
    top = ranked.orderBy(*order).limit(base - least)
    top = top.select("media_id", (base + 1 - F.row_number().over(Window.orderBy(*order))).alias("high"))
    return ranked.join(F.broadcast(top), "media_id", "left").select("media_id", F.coalesce("high", F.lit(least)).alias("score"))


def length_units(text: Column) -> Column:
    """Chinese characters plus words of ASCII letters and digits; two or fewer make a short query."""
    own = F.coalesce(text, F.lit(""))
    return F.length(F.regexp_replace(own, "[^㐀-鿿]", "")) + F.size(F.regexp_extract_all(own, F.lit("[a-zA-Z0-9]+"), F.lit(0)))


def synonym_tokens(seeds: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(seed, token): each seed, its ``synonyms`` (key, value) as a key, and for each key that it is a value of, that key and its values.

    Joins by word, so seeds of many queries are expanded at once; blank words are passed over.
    """
    own = seeds.select(F.trim("seed").alias("seed")).where("seed <> ''").distinct()
    pairs = synonyms.select(F.trim("key").alias("key"), F.trim("value").alias("value")).where("key <> '' AND value <> ''").distinct()
    keys = own.join(pairs.withColumnRenamed("value", "seed"), "seed").select("seed", "key")
    values = own.withColumn("key", F.col("seed")).unionByName(keys).join(pairs, "key").select("seed", F.col("value").alias("token"))
    parts = [own.select("seed", F.col("seed").alias("token")), keys.select("seed", F.col("key").alias("token")), values]
    return reduce(DataFrame.unionByName, parts).distinct()


def groups_needed(groups: int) -> int:
    """How many of a query's word groups a text must meet."""
    return 0 if groups <= 0 else 1 if groups <= 2 else min(groups - 1, 3)


def passes_gate(text: Column, groups: list[list[str]], actions: list[str] | None = None, least: int = 1) -> Column:
    """Whether ``text`` has, as substrings in lower case, ``least`` words of the ``groups``, words of as many groups as ``groups_needed``,
    and, where groups have words of ``actions``, a word of one of those. Without words nothing passes; a null text is empty."""
    own = [sorted({w.lower() for w in g if w}) for g in groups]
    words = sorted({w for g in own for w in g})
    if not words:
        return F.lit(False)
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda ws: reduce(Column.__or__, (F.contains(low, F.lit(w)) for w in ws), F.lit(False))
    total = lambda cs: reduce(Column.__add__, (c.cast("int") for c in cs))
    doing = [g for g in own if set(g) & {a.lower() for a in actions or []}]
    out = (total(has([w]) for w in words) >= max(least, 1)) & (total(map(has, own)) >= groups_needed(len(own)))
    return out & has([w for g in doing for w in g]) if doing else out


def gated(hits: DataFrame, found: DataFrame, docs: DataFrame, passes: Column) -> DataFrame:
    """Of vector ``hits`` (media_id, ...) those that full-text search ``found`` (media_id) as well, or whose text in ``docs`` ``passes``.

    The texts of hits are written first: as a condition of the join, ``passes`` would be tried on all texts.
    """
    own = kept(docs.join(hits.select("media_id").distinct(), "media_id", "left_semi"))
    sure = found.select("media_id").unionByName(own.where(passes).select("media_id")).distinct()
    return hits.join(sure, "media_id", "left_semi")
