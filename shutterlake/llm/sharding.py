"""Two-pass external shuffle into shards.

Pass 1 (``scatter``) sends each record to its shard and, within it, to one of as many buckets as keep a bucket near
``bucket_bytes``, by seeded hashes. Pass 2 (``shuffled``) puts each bucket into a random order by a seeded Fisher-Yates shuffle
in one task and writes it; the buckets of a shard follow each other, so a shard is shuffled as a whole although no task held it.

The shard of a record is the one of highest hash with its doc_id (``key`` law): doc_id and the number of shards decide alone,
and one more shard takes records only into itself. The bucket's hash also takes the record's place in the input, so that
records that share an id, or copies of one text, spread over the buckets of their shard. Shards grow with the corpus, buckets
don't.

Defined results: a null text has size 8 and the checksum of no bytes; a null doc_id counts as the id "" and repeated rows are
records of their own; an empty table gives no records; other columns travel with the records.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.llm.common import free_names, seeds, work_dir

SHARDS = 24
BUCKET_BYTES = 32 << 20
SEED = 20_240_607


def shard_of(doc_id: Column, shards: int, seed: int = SEED) -> Column:
    """The shard, of 0 to shards - 1, whose hash with doc_id is highest."""
    key = F.coalesce(doc_id.cast("string"), F.lit(""))
    best = F.array_max(F.array(*(F.struct(F.xxhash64(key, F.lit(seed), F.lit(k)).alias("h"), F.lit(k).alias("k")) for k in range(shards))))
    return best["k"]


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 8


def scatter(docs: DataFrame, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> tuple[DataFrame, list[str]]:
    """``docs`` with a record's shard, bucket and place as last columns, and their names. The driver sees the bytes of each shard."""
    names = free_names(docs, "_shard", "_bucket", "_place")
    size, shard = size_of(F.col("text")), shard_of(F.col("doc_id"), shards, seed)
    sums = {r["s"]: r["b"] for r in docs.groupBy(shard.alias("s")).agg(F.sum(size).alias("b")).collect()}
    buckets = F.array(*(F.lit(max(1, -(-sums.get(k, 0) // bucket_bytes))) for k in range(shards)))
    place = F.xxhash64(F.monotonically_increasing_id(), F.col("doc_id"), F.lit(seed + 1))
    out = docs.withColumn(names[0], shard).withColumn(names[2], place)
    bucket = F.pmod(F.col(names[2]), F.element_at(buckets, F.col(names[0]) + 1)).cast("int")
    return out.withColumn(names[1], bucket).select(*docs.columns, *names), names


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A permutation of 0 to n - 1; numpy's is a Fisher-Yates shuffle."""
    return np.random.Generator(np.random.PCG64(seed)).permutation(n)


def shuffled(scattered: DataFrame, names: list[str], seed: int = SEED) -> tuple[DataFrame, list[str]]:
    """Each bucket in its random order, and the names of shard, bucket and place in that order, the last columns. The order is of
    the records' hashes first, so a task run again makes it again."""
    shard, bucket_, place = names
    columns = [c for c in scattered.columns if c != place]
    (nth,) = free_names(scattered, "_nth")

    def order(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by([(place, "ascending")])
        key = seeds(1, seed + (bucket.column(shard)[0].as_py() << 32) + bucket.column(bucket_)[0].as_py())
        out = bucket.select(columns).take(pa.array(fisher_yates(bucket.num_rows, int(key[0]))))
        return out.append_column(nth, pa.array(np.arange(bucket.num_rows, dtype=np.int64)))

    kinds = ", ".join(f"`{c}` {scattered.schema[c].dataType.simpleString()}" for c in columns)
    return scattered.groupBy(shard, bucket_).applyInArrow(order, f"{kinds}, `{nth}` bigint"), [shard, bucket_, nth]


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """Writes the records to a folder of ``path`` for each shard, in shuffled order, and returns the table as written; its last
    columns are shard, bucket and place in the bucket (_shard, _bucket, _nth, or alike if columns of ``docs`` have these names)."""
    out, names = shuffled(*scatter(docs, shards, bucket_bytes, seed), seed)
    out.write.partitionBy(names[0]).parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path).select(*docs.columns, *names)


def slotted(records: DataFrame) -> DataFrame:
    """Columns of a written table, _shard, _bucket and _nth among them, with ``slot``: 0, 1, ... in a shard, bucket by bucket.

    Select what is needed first: the join with the buckets' counts may move the rows.
    """
    counts = records.groupBy("_shard", "_bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_shard", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return records.join(bases, ["_shard", "_bucket"]).withColumn("slot", F.col("base") + F.col("_nth")).drop("base")


def digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """What op9 returns, from the shards as written."""
    back = write_shards(docs.select("doc_id", "text"), work_dir(docs.sparkSession), shards)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    own = back.select("doc_id", size_of(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), "_shard", "_bucket", "_nth")
    grown = shard_of(F.col("doc_id"), shards + 1).cast("int").alias("grown_shard")
    return slotted(own).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("_shard").cast("int").alias("shard"), "slot", grown)
