"""A kept inverted index: written once, changed document by document, searched without reading texts.

Tables under one path, each in folders by generation:

- ``postings``: a row for each (token, block of SPAN ids), or, where the block has much text, some rows, each of other documents: the
  entries (place in the block, weight tf, document length d) in order, their number, and the largest tf and least d, which bound every
  score in the row. Rows lie in buckets by a hash of the token and are sorted by it in each file, so a search reads the buckets and row
  groups of its tokens. A token of all documents has many rows, never a long one.
- ``docs``: (media_id, d); d null: deleted. ``dead``: (media_id, of, d): the generation whose entries of a document no longer count.
- ``stats``: how many documents, and of what length, a generation adds and takes away. It is written last: a generation without it
  does not exist, so a write that was broken off is done again over itself and never seen in part.

A change adds a generation with the new documents' entries alone and names the old ones dead; all entries of a document are in one
generation, so scores are made within (generation, block).

Defined results: an index has one document for each id: of rows that share an id in one write, entries add up. Null ids are left
out; empty texts count as documents of length 0; an empty table makes an empty index.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions.batches import utf8
from shutterlake.operators import search
from shutterlake.sources.shared import kept, many

SPAN, BUCKETS, STRETCH = 1 << 12, 16, 64
SLICE_BYTES, MOST_BYTES = 4 << 20, 32 << 20
#: A search for the best k looks at so many blocks before it passes over blocks.
FIRST = 16
_POSTINGS = "token string, block bigint, entries array<struct<o: smallint, tf: double, d: int>>, n int, max_tf double, min_d int, generation int, bucket int"
_DOCS = "media_id bigint, d int, generation int"
_DEAD = "media_id bigint, of int, d int, generation int"
_STATS = "added bigint, added_d bigint, gone bigint, gone_d bigint, generation int"
SEPARATOR = "\x1f"


def fulltext(docs: DataFrame, fields: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """Entries and sizes (media_id, d) of the columns by their weights. Entries are rows of ``postings``."""
    own = docs.select("media_id", *(F.lower(F.coalesce(F.col(c), F.lit(""))).alias(f"t{k}") for k, c in enumerate(fields)))
    letters = search.token_letters(docs.sparkSession)
    sizes = own.where("media_id IS NOT NULL").mapInArrow(_sizes(letters, len(fields)), "media_id bigint, d bigint")
    return _gathered(own, list(fields.values()), [""] * len(fields), False, letters), sizes


def termed(docs: DataFrame, fields: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Entries and sizes of the terms of columns by field name; a token is the field and the term."""
    own = docs.select("media_id", *(search.terms(F.coalesce(F.col(c), F.lit(""))).alias(f"t{k}") for k, c in enumerate(fields.values())))
    return _gathered(own, [1.0] * len(fields), [f + SEPARATOR for f in fields], True, None), docs.where("media_id IS NOT NULL").select("media_id", F.lit(0).alias("d"))


_ENTRY = pa.struct([("o", pa.int16()), ("tf", pa.float64()), ("d", pa.int32())])
_ROWS = "token string, block bigint, entries array<struct<o: smallint, tf: double, d: int>>, n int, max_tf double, min_d int"


def _cut(texts: pa.Array, letter: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """``search.tokens`` of lower-case texts end to end, and how many are of each. letter: by code point."""
    data, offsets = utf8(texts)
    own = np.append(letter[:128], np.zeros(128, bool))[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
        code = data[lead].astype(np.int64) & (0x7F >> size)
        for k in range(1, 4):
            code[size > k] = code[size > k] << 6 | data[lead[size > k] + k] & 0x3F
        for k in range(4):
            own[lead[letter[code] & (size > k)] + k] = True
    first = own.copy()
    first[1:] &= ~own[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[heads] = own[heads]
    starts = np.flatnonzero(first)
    ends = np.append(np.searchsorted(np.flatnonzero(own), starts), own.sum()).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data[own])), np.diff(np.searchsorted(starts, offsets))


def _letter(ranges: np.ndarray) -> np.ndarray:
    out = np.zeros(0x110000, bool)
    for a, b in ranges:
        out[a:b] = True
    return out


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows of about ``size`` bytes."""
    for batch in batches:
        step = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
        for a in range(0, batch.num_rows, step):
            yield batch.slice(a, step)


def _sizes(ranges: np.ndarray, fields: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = _letter(ranges)
        for batch in _slices(batches, SLICE_BYTES):
            d = sum(_cut(batch.column(f"t{k}"), letter)[1] for k in range(fields))
            yield pa.RecordBatch.from_arrays([batch.column("media_id").cast(pa.int64()), pa.array(d.astype(np.int64))], names=["media_id", "d"])

    return task


def _lists(first: np.ndarray, o: np.ndarray, tf: np.ndarray, d: np.ndarray) -> pa.Array:
    fields = [pa.array(o.astype(np.int16)), pa.array(tf.astype(np.float64)), pa.array(d.astype(np.int32))]
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays(fields, fields=list(_ENTRY)))


def _begins(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    return np.flatnonzero(np.concatenate([[True], reduce(np.logical_or, (k[1:] != k[:-1] for k in keys))])) if len(keys[0]) else np.zeros(0, np.int64)


def _rows_of(ids: np.ndarray, tokens: list[pa.DictionaryArray], counts: list[np.ndarray], weights: list[float], once: bool, sized: bool, span: int) -> pa.RecordBatch:
    """Rows of some documents by rising id, from their tokens by field."""
    first = _begins(ids)
    d = np.maximum.reduceat(sum(counts), first) if sized else np.zeros(len(first), np.int64)
    doc = np.cumsum(np.isin(np.arange(len(ids)), first, assume_unique=True)) - 1
    whole = pa.chunked_array(tokens).unify_dictionaries().combine_chunks()
    key = whole.indices.to_numpy().astype(np.int64) * len(first) + np.concatenate([np.repeat(doc, n) for n in counts])
    key = np.sort(key * len(weights) + np.repeat(np.arange(len(weights)), [len(t) for t in tokens]))
    each = _begins(key)
    tf = np.array(weights)[key[each] % len(weights)] * (1 if once else np.diff(np.append(each, len(key))))
    key = key[each] // len(weights)
    each = _begins(key)
    if len(each):
        tf = (np.maximum if once else np.add).reduceat(tf, each)
    token, at = np.divmod(key[each], len(first))
    block, o, d = ids[first][at] // span, ids[first][at] % span, d[at]
    new = _begins(token, block)
    most, least = (f.reduceat(x, new) if len(new) else x for f, x in ((np.maximum, tf), (np.minimum, d)))
    ends = np.append(new, len(token))
    return pa.RecordBatch.from_arrays([whole.dictionary.take(pa.array(token[new])), pa.array(block[new]), _lists(ends, o, tf, d), pa.array(np.diff(ends).astype(np.int32)), pa.array(most.astype(np.float64)), pa.array(least.astype(np.int32))], names=["token", "block", "entries", "n", "max_tf", "min_d"])


def _gathered(docs: DataFrame, weights: list[float], prefixes: list[str], once: bool, letters: np.ndarray | None) -> DataFrame:
    """Rows of documents (media_id, and a column for each weight: texts in lower case, or without ``letters`` lists of tokens). The documents of
    a block meet in one task, by id, so its rows are made there and nothing has to be merged. Rows are made at ends of blocks, or, of
    blocks of more than MOST_BYTES, at ends of ids."""
    span, least, most = SPAN, SLICE_BYTES, MOST_BYTES

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = None if letters is None else _letter(letters)
        ids, tokens, counts, size = [], [[] for _ in weights], [[] for _ in weights], 0

        def rows(final: bool) -> Iterator[pa.RecordBatch]:
            """Of the documents in hand, as far as they are whole."""
            nonlocal ids, tokens, counts, size
            own = np.concatenate(ids)
            ends = len(own) if final else _begins(own // span)[-1] or (_begins(own)[-1] if size >= most else 0)
            ids, n = [own[ends:]], [np.concatenate(c) for c in counts]
            if not ends:
                ids, counts = [own], [[c] for c in n]
                return
            whole = [pa.chunked_array(t).unify_dictionaries().combine_chunks() for t in tokens]
            at = [int(c[:ends].sum()) for c in n]
            if sum(at):
                yield _rows_of(own[:ends], [t[:a] for t, a in zip(whole, at, strict=True)], [c[:ends] for c in n], weights, once, letters is not None, span)
            # the words of the rest alone
            tokens, counts = [[t[a:].dictionary_decode().dictionary_encode()] for t, a in zip(whole, at, strict=True)], [[c[ends:]] for c in n]
            size = int(size * (1 - ends / len(own)))

        for batch in _slices(batches, least):
            ids.append(batch.column("media_id").to_numpy())
            size += batch.nbytes
            for k, prefix in enumerate(prefixes):
                column = batch.column(f"t{k}")
                flat, n = _cut(column, letter) if letter is not None else (column.flatten(), column.value_lengths().to_numpy())
                own = flat.dictionary_encode()
                tokens[k].append(pa.DictionaryArray.from_arrays(own.indices, pc.binary_join_element_wise(prefix, own.dictionary, "")) if prefix else own)
                counts[k].append(n)
            if size >= least:
                yield from rows(False)
        if ids:
            yield from rows(True)

    own = docs.where("media_id IS NOT NULL").withColumn("media_id", F.col("media_id").cast("bigint"))
    return own.repartition(many(docs.sparkSession), F.floor(F.col("media_id") / SPAN)).sortWithinPartitions("media_id").mapInArrow(task, _ROWS)


def _read(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def _committed(spark: SparkSession, path: str) -> list[int]:
    return [r[0] for r in _read(spark, path, "stats", _STATS).select("generation").distinct().collect()]  # a row a change


def _write(entries: DataFrame, sizes: DataFrame, dead: DataFrame, path: str, generation: int) -> None:
    spark = entries.sparkSession
    bucket = F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int")
    # a bucket is some files; a frequent token's rows are of them all, by stretches of blocks
    stretch = F.pmod(F.xxhash64("token", F.floor(F.col("block") / STRETCH)), F.lit(-(-many(spark) // BUCKETS)))
    at = f"generation={generation}"
    rows = entries.withColumn("bucket", bucket).repartition(many(spark), "bucket", stretch)
    rows.sortWithinPartitions("bucket", "token", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/{at}")
    sizes.select("media_id", F.col("d").cast("int").alias("d")).write.mode("overwrite").parquet(f"{path}/docs/{at}")
    dead.select("media_id", "of", "d").write.mode("overwrite").parquet(f"{path}/dead/{at}")
    new = spark.read.schema("media_id bigint, d int").parquet(f"{path}/docs/{at}").where("d IS NOT NULL").agg(F.count("*").alias("added"), F.coalesce(F.sum("d"), F.lit(0)).alias("added_d"))
    old = spark.read.schema("media_id bigint, of int, d int").parquet(f"{path}/dead/{at}").agg(F.count("*").alias("gone"), F.coalesce(F.sum("d"), F.lit(0)).alias("gone_d"))
    new.join(F.broadcast(old)).write.mode("overwrite").parquet(f"{path}/stats/{at}")  # two rows


def build(entries: DataFrame, sizes: DataFrame, path: str) -> None:
    """Writes a new index."""
    none = entries.sparkSession.createDataFrame([], "media_id bigint, of int, d int")
    _write(entries, sizes.groupBy("media_id").agg(F.sum("d").alias("d")), none, path, 0)


def change(entries: DataFrame, sizes: DataFrame, deleted: DataFrame, path: str) -> None:
    """Puts the documents of ``sizes`` in the place of those with their ids, and takes those of ``deleted`` (media_id) out."""
    spark = entries.sparkSession
    done = _committed(spark, path)
    sizes = kept(sizes.groupBy("media_id").agg(F.sum("d").alias("d")))
    gone = deleted.select("media_id").where("media_id IS NOT NULL").distinct().join(sizes, "media_id", "left_anti")
    ids = sizes.select("media_id").unionByName(gone.select("media_id"))
    now = _read(spark, path, "docs", _DOCS).where(F.col("generation").isin(done)).join(ids, "media_id", "left_semi")
    last = now.groupBy("media_id").agg(F.max(F.struct("generation", "d")).alias("l")).where("l.d IS NOT NULL")
    dead = last.select("media_id", F.col("l.generation").alias("of"), F.col("l.d").alias("d"))
    _write(entries, sizes.unionByName(gone.select("media_id", F.lit(None).cast("bigint").alias("d"))), dead, path, max(done) + 1)


def _rows(spark: SparkSession, path: str, tokens: list[str]) -> DataFrame:
    """Rows of the tokens; entries of dead documents are taken out."""
    own = spark.createDataFrame([(t,) for t in tokens], "token string").select(F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int")).distinct()
    buckets = [r[0] for r in own.collect()]  # a row a token
    return _alive(spark, path, lambda rows: rows.where(F.col("bucket").isin(buckets) & F.col("token").isin(tokens)))


def _alive(spark: SparkSession, path: str, some: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of the index that ``some`` keeps, without the entries of dead documents."""
    done = _committed(spark, path)
    rows = some(_read(spark, path, "postings", _POSTINGS).where(F.col("generation").isin(done)))
    dead = _read(spark, path, "dead", _DEAD).where(F.col("generation").isin(done))
    places = dead.groupBy(F.col("of").alias("generation"), F.floor(F.col("media_id") / SPAN).alias("block")).agg(F.collect_set(F.pmod("media_id", F.lit(SPAN)).cast("smallint")).alias("gone"))
    met = rows.join(places, ["generation", "block"], "left")
    left = F.when(F.col("gone").isNull(), F.col("entries")).otherwise(F.filter("entries", lambda e: ~F.array_contains(F.col("gone"), e["o"])))
    n = F.when(F.col("gone").isNull(), F.col("n")).otherwise(F.size(left))
    return met.select("token", "generation", "block", left.alias("entries"), n.alias("n"), "max_tf", "min_d")


def _parts(spark: SparkSession, path: str, rows: DataFrame, wanted: list[str]) -> tuple[dict[str, float], float]:
    """The weight of each token and the mean length of a document; a few numbers."""
    s = _read(spark, path, "stats", _STATS).agg(F.sum(F.col("added") - F.col("gone")).alias("n"), F.sum(F.col("added_d") - F.col("gone_d")).alias("d")).first()
    df = {r["token"]: r["n"] for r in rows.groupBy("token").agg(F.sum("n").alias("n")).collect()}
    total, mean = s["n"] or 0, (s["d"] or 0) / (s["n"] or 1)
    idf = {t: math.log((total - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5)) for t in wanted}
    return {t: v if v > 0 else 1e-6 for t, v in idf.items()}, mean


def _part(idf: dict[str, float], mean: float, tf: Column, d: Column) -> Column:
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in idf.items() for x in kv)), F.col("token"))
    return weight * tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * d / (mean or 1.0)))


def _scored(rows: DataFrame, idf: dict[str, float], mean: float) -> DataFrame:
    each = rows.select("token", "block", F.explode("entries").alias("e")).select((F.col("block") * SPAN + F.col("e.o")).alias("media_id"), "token", F.col("e.tf").alias("tf"), F.col("e.d").alias("d"))
    own = each.groupBy("media_id").agg(F.sum(_part(idf, mean, F.col("tf"), F.col("d"))).alias("score"), F.count("*").alias("met"))
    return own.where(F.col("met") == len(idf)).select("media_id", "score")


def bm25(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """(media_id, score) of the documents that have all ``wanted`` tokens."""
    wanted = list(dict.fromkeys(wanted))
    rows = _rows(spark, path, wanted)
    return _scored(rows, *_parts(spark, path, rows, wanted))


def bm25_top(spark: SparkSession, path: str, wanted: list[str], k: int) -> DataFrame:
    """The best ``k`` of ``bm25``, by score to 9 places, then id. Blocks whose bound is below the kth best score of the first few are not read."""
    wanted = list(dict.fromkeys(wanted))
    rows = _rows(spark, path, wanted)
    idf, mean = _parts(spark, path, rows, wanted)
    bound = F.sum(_part(idf, mean, F.col("max_tf"), F.col("min_d"))).alias("bound")
    one = rows.groupBy("generation", "block", "token").agg(F.max("max_tf").alias("max_tf"), F.min("min_d").alias("min_d"))
    bounds = one.groupBy("generation", "block").agg(bound, F.count("*").alias("met")).where(F.col("met") == len(wanted)).select("generation", "block", "bound")
    order = [F.round("score", 9).desc(), F.col("media_id")]
    first = F.broadcast(bounds.orderBy(F.desc("bound")).limit(FIRST))  # FIRST rows
    least = _scored(rows.join(first, ["generation", "block"], "left_semi"), idf, mean).orderBy(*order).limit(k).agg(F.count("*").alias("n"), F.min("score").alias("s")).first()
    if least["n"] == k:
        rows = rows.join(bounds.where(F.col("bound") >= least["s"] - 1e-9), ["generation", "block"], "left_semi")
    return _scored(rows, idf, mean).orderBy(*order).limit(k)


def term_recall(spark: SparkSession, path: str, fields: list[str], wanted: list[str]) -> DataFrame:
    """``search.term_recall`` from an index of ``termed``."""
    rows = _rows(spark, path, [f + SEPARATOR + t for f in fields for t in wanted])
    token = F.split("token", SEPARATOR)
    each = rows.select(token[0].alias("field"), token[1].alias("term"), "block", F.explode("entries.o").alias("o"))
    return search.term_recall(each.select((F.col("block") * SPAN + F.col("o")).alias("media_id"), "field", "term"), wanted)


def segment_recall(spark: SparkSession, path: str, fields: list[str], queries: DataFrame) -> DataFrame:
    """(query_id, media_id, score) for many ``queries`` (query_id, segment, term) at once, from an index of ``termed``: media that have a term of
    each of a query's segments, in any field. The score sums field and term weights of all of a query's terms that a media row has, each
    (field, term) once. Rows of the index meet queries by token; a query's media are added up in Spark."""
    wanted = kept(queries.where("term <> ''").select("query_id", "segment", "term").distinct())
    tokens = wanted.select("query_id", "segment", "term", F.explode(F.array(*map(F.lit, fields))).alias("field")).withColumn("token", F.concat("field", F.lit(SEPARATOR), "term"))
    rows = _alive(spark, path, lambda r: r.join(tokens.select("token").distinct(), "token", "left_semi"))
    hits = rows.select("token", "block", F.explode("entries.o").alias("o")).join(tokens, "token")
    hits = hits.select("query_id", "segment", "field", "term", (F.col("block") * SPAN + F.col("o")).alias("media_id"))
    weight = F.coalesce(F.create_map(*(F.lit(x) for kv in search.FIELD_WEIGHTS.items() for x in kv))[F.col("field")], F.lit(search.OTHER_FIELD)) + F.when(F.length("term") >= 2, search.LONG_TERM).otherwise(search.SHORT_TERM)
    # a term of two segments meets both, and counts once
    one = hits.groupBy("query_id", "media_id", "field", "term").agg(F.collect_set("segment").alias("segments"), F.max(weight).alias("w"))
    own = one.groupBy("query_id", "media_id").agg(F.sum("w").alias("score"), F.size(F.array_distinct(F.flatten(F.collect_list("segments")))).alias("met"))
    parts = wanted.groupBy("query_id").agg(F.count_distinct("segment").alias("parts"))
    return own.join(parts, "query_id").where("met = parts").select("query_id", "media_id", "score")
