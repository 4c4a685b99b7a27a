"""Groups with counts and covers, facets, album and person cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.functions.media import cover_rank


def groups(media: DataFrame, key: Column) -> DataFrame:
    """(user_id, key, n, cover_id) of each user's groups: the best by ``cover_rank`` is the cover. One partial aggregation: a key
    that many rows have is no hot one."""
    return media.groupBy("user_id", key.alias("key")).agg(F.count("*").alias("n"), F.max(cover_rank())["id"].alias("cover_id"))


def facet(media: DataFrame, key: Column) -> DataFrame:
    return media.groupBy(key.alias("key")).agg(F.count("*").alias("n"))


def album_stats(edges: DataFrame, media: DataFrame) -> DataFrame:
    """Per album: live media, the latest added as cover (the larger id of two), first and last capture."""
    joined = edges.join(media.select(F.col("id").alias("media_id"), "captured_at"), "media_id")
    latest = F.max(F.struct("added_at", "media_id"))["media_id"]
    return joined.groupBy("album_id").agg(F.count("*").alias("media_count"), latest.alias("cover_media_id"), F.min("captured_at").alias("first_at"), F.max("captured_at").alias("last_at"))


def person_cards(faces: DataFrame, media: DataFrame) -> DataFrame:
    """Per user and cluster: name, distinct live media, cover face (manual, then default, then smallest id), times."""
    joined = faces.join(media.select(F.col("id").alias("media_id"), "captured_at"), "media_id")
    cover = F.min(F.struct((-F.col("representative_type")).alias("r"), "face_id"))["face_id"]
    return joined.groupBy("user_id", "cluster_id").agg(
        F.max(F.expr("nullif(trim(name), '')")).alias("name"), F.count_distinct("media_id").alias("media_count"), cover.alias("cover_face_id"),
        F.min("captured_at").alias("first_at"), F.max("captured_at").alias("last_at"))


def displayable(edges: DataFrame, media: DataFrame, least: int = 2) -> DataFrame:
    """Groups with ``least`` live members."""
    return edges.join(media.select(F.col("id").alias("media_id")), "media_id", "left_semi").groupBy("album_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)


#: Ids are numbered in runs of so many, so that a name of many files is no hot key.
RUN = 1 << 16


def numbered(rows: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` with k, their place (from 0) among the rows of their ``key`` in the order of the number ``by``."""
    cut = rows.withColumn("run", F.floor(F.col(by) / RUN))
    counts = cut.groupBy(key, "run").agg(F.count("*").alias("c"))
    before = Window.partitionBy(key).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(key, "run", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy(key, "run").orderBy(by)) - 1
    return cut.withColumn("nth", nth).join(bases, [key, "run"]).select(*rows.columns, (F.col("base") + F.col("nth")).alias("k"))


_STEM = r"(?s)^(.+?)(\.[^.]*)?$"
_NUMBERED = r"(?s)^(.+)_([0-9]{1,9})(\.[^.]*)?$"


def numbered_names(files: DataFrame) -> DataFrame:
    """File names made distinct: the second of a name gets the suffix _1 before its extension, and so on, by id.

    Where files truly have such names ("a_3.jpg" beside two "a.jpg"), numbers go on after the largest of them, so no name is given that
    a file has. A null name stays null.
    """
    once = files.where("name IS NOT NULL").select("name").distinct().where(F.col("name").rlike(_NUMBERED))
    part = lambda i: F.regexp_extract("name", _NUMBERED, i)
    largest = once.groupBy(F.concat(part(1), part(3)).alias("__name")).agg(F.max(part(2).cast("bigint")).alias("__largest"))
    rows = numbered(files.where("name IS NOT NULL"), "name", "id").join(largest, F.col("name") == F.col("__name"), "left")
    number = F.col("k") + F.coalesce("__largest", F.lit(0))
    suffixed = F.concat(F.regexp_extract("name", _STEM, 1), F.lit("_"), number.cast("string"), F.regexp_extract("name", _STEM, 2))
    named = rows.select(*files.columns, F.when(F.col("k") == 0, F.col("name")).otherwise(suffixed).alias("unique_name"))
    return named.unionByName(files.where("name IS NULL").select(*files.columns, F.lit(None).cast("string").alias("unique_name")))
