"""Pages of a kept ranking from which rows vanish, and covers by a rule that is no order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shutterlake.operators.people import AREA_STEP, EXPRESSIONS, KEYS, POSE_STEP, QUALITY_STEP, SHARPNESS_STEP
from shutterlake.sources.shared import kept

#: Places of a kept ranking lie in blocks of so many.
BLOCK = 1_000


def keep(ranking: DataFrame, order: list[Column], path: str) -> None:
    """Writes ``ranking`` (id, ...) with the place of each row (from 0) in folders of BLOCK places.

    Places come from ranges of the order: each range counts its rows, and begins where those before end, so no task orders all.
    """
    cut = ranking.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    rows = kept(cut)
    counts = rows.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("__part", before.alias("base"))  # a row a range
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    placed = rows.withColumn("place", nth).join(F.broadcast(bases), "__part").withColumn("place", (F.col("place") + F.col("base")).cast("bigint")).drop("__part", "base")
    placed.withColumn("block", F.floor(F.col("place") / BLOCK)).repartition("block").write.partitionBy("block").parquet(path)


def page(spark: SparkSession, path: str, schema: str, live: DataFrame, offset: int, size: int) -> DataFrame:
    """(place, and the columns of ``schema``) of the first ``size`` rows from place ``offset`` on that are in ``live`` (id), by place.

    Reads the offset's block, and twice as many each time that too many of its rows have vanished.
    """
    ranking = spark.read.schema(f"{schema}, place bigint, block bigint").parquet(path)
    last = ranking.agg(F.max("block")).first()[0]
    first, many = offset // BLOCK, 1
    while True:
        rows = ranking.where(F.col("block").between(first, first + many - 1) & (F.col("place") >= offset)).join(live.select("id"), "id", "left_semi").drop("block")
        if last is None or first + many > last or rows.count() >= size:
            return rows.orderBy("place").limit(size)
        many *= 2


#: Faces are compared in tiles of so many ids, then the tiles' best by tiles of as many tiles, then what is left.
TILE = 1 << 12


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def metrics() -> Column:
    """What covers are compared by: columns as for ``people.cover_rank``; nulls count as 0, and so does a box that is not of four numbers."""
    liked = F.coalesce(F.create_map(*(F.lit(x) for kv in EXPRESSIONS.items() for x in kv))[F.col("expression")], F.lit(0))
    pose = F.greatest(F.lit(0.0), 1 - (F.abs(_zero("yaw")) / 90 + F.abs(_zero("pitch")) / 90) / 2)
    side = lambda a, b: F.col("bbox")[b] - F.col("bbox")[a]
    area = F.coalesce(F.when(F.size("bbox") == 4, side(0, 2) * side(1, 3)), F.lit(0.0)).cast("double")
    return F.struct(
        F.col("face_id").alias("face_id"), F.when(F.col("media_type") == "video", 1).otherwise(0).alias("video"), liked.alias("liked"), _zero("quality_score").alias("quality"),
        pose.alias("pose"), area.alias("area"), _zero("sharpness_score").alias("sharpness"), _zero("created_at").alias("at"))


def beats(b: Column, a: Column) -> Column:
    """Whether face ``b`` comes before ``a``: no video, expression, then quality, pose, size and sharpness where they differ by more than
    their tolerance, then the later media; an equal one does not."""
    by = [("quality", QUALITY_STEP), ("pose", POSE_STEP), ("area", AREA_STEP), ("sharpness", SHARPNESS_STEP)]
    cases = F.when(a["video"] != b["video"], b["video"] < a["video"]).when(a["liked"] != b["liked"], b["liked"] > a["liked"])
    for name, step in by:
        cases = cases.when(F.abs(a[name] - b[name]) > step, b[name] > a[name])
    return F.coalesce(cases.otherwise(b["at"] > a["at"]), F.lit(False))


def _winner(found: Column) -> Column:
    """The face left of an array: each next one by id takes the place if it beats the one that has it."""
    return F.aggregate(F.slice(found, F.lit(2), F.greatest(F.size(found), F.lit(1))), F.element_at(found, 1), lambda a, b: F.when(beats(b, a), b).otherwise(a))


def tolerant_covers(faces: DataFrame, tile: int = TILE) -> DataFrame:
    """(user_id, cluster_id, face_id): the face that is left of each cluster when faces meet by rising id, in tiles of ``tile`` ids, then the
    tiles' faces, and so on.

    Tolerances between each two make no order, so who is left can hang on who meets whom; where they do make one on a cluster's faces,
    this is its first. Null ids are left out.
    """
    rows = faces.where("face_id IS NOT NULL").select(*KEYS, metrics().alias("f"))
    for width in (tile, tile * tile, None):
        part = [F.floor(F.col("f.face_id") / width).alias("__tile")] if width else []
        rows = rows.groupBy(*KEYS, *part).agg(_winner(F.array_sort(F.collect_list("f"))).alias("f"))
    return rows.select(*KEYS, F.col("f.face_id").alias("face_id"))


def candidates(groups: DataFrame, media: DataFrame, least: int = 2) -> DataFrame:
    """Groups of near duplicates as they are shown: members (group_id, id, rank_score, similarity) that are in ``media`` (id), of groups with
    ``least`` of them, with ``recommended``, by which all but the first by score, then id, are to go."""
    own = groups.join(media.select("id"), "id", "left_semi")
    first = own.groupBy("group_id").agg(F.count("*").alias("n"), F.max(F.struct("rank_score", (-F.col("id")).alias("i"))).alias("best")).where(F.col("n") >= least)
    out = own.join(first, "group_id")
    return out.select("group_id", "id", "rank_score", "similarity", "n", (-F.col("best.i") != F.col("id")).alias("recommended"))


def group_page(groups: DataFrame, media: DataFrame, page_: int, size: int) -> DataFrame:
    """Members of a page of shown groups: groups by falling number of members, then id; members by falling score, then id."""
    shown = candidates(groups, media)
    heads = shown.select("group_id", "n").distinct().orderBy(F.desc("n"), "group_id").offset((max(page_, 1) - 1) * size).limit(size)
    return shown.join(F.broadcast(heads.select("group_id")), "group_id", "left_semi").orderBy(F.desc("n"), "group_id", F.desc("rank_score"), "id")


def deleted_in_group(groups: DataFrame, group_id: int, ids: list[int]) -> tuple[DataFrame, DataFrame]:
    """(the rows left of ``groups``, the ids that go to the trash) when ``ids`` of one group are deleted: ids of other groups are left
    alone, deleted ones leave all their groups, and groups with one member left are no groups any more."""
    gone = groups.where((F.col("group_id") == group_id) & F.col("id").isin(ids)).select("id").distinct()
    left = groups.join(gone, "id", "left_anti")
    alive = left.groupBy("group_id").agg(F.count("*").alias("__n")).where("__n > 1")
    return left.join(alive, "group_id", "left_semi").select(*groups.columns), gone
