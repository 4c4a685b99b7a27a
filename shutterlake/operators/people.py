"""Changes of face clusters: rows (user_id, cluster_id, face_id, representative_type, is_user_assigned, name), for many users at once.

representative_type is 2 for a cover chosen by hand, 1 for the default cover, else 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.operators import tables

KEYS = ["user_id", "cluster_id"]


def _auto() -> Column:
    return ~F.coalesce("is_user_assigned", F.lit(False))


def inserted(rows: DataFrame, new: DataFrame, known: DataFrame, replace_auto: bool = False) -> DataFrame:
    """``rows`` with ``new`` ones (user_id, cluster_id, face_id) whose face is ``known`` (face_id). A face that comes anew leaves the
    clusters it was put in automatically, with ``replace_auto`` all of a user's automatic rows go; rows made by hand stay, and a new
    row that is there already is passed over."""
    fit = new.select(*KEYS, "face_id").distinct().join(known.select("face_id").distinct(), "face_id", "left_semi")
    which = ["user_id"] if replace_auto else ["user_id", "face_id"]
    gone = rows.where(_auto()).join(fit.select(*which).distinct(), which, "left_semi").select(*KEYS, "face_id")
    stay = rows.join(gone, [*KEYS, "face_id"], "left_anti").select(*rows.columns)
    plain = {"representative_type": F.lit(0), "is_user_assigned": F.lit(False)}
    made = fit.select(*(F.col(c) if c in (*KEYS, "face_id") else plain.get(c, F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns))
    return tables.insert_ignore(stay, made, [*KEYS, "face_id"])


def moved(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """``rows`` after ``moves`` (user_id, source, face_id, target, name): faces leave the source; in the target, which takes the new name
    or else the one it has, all rows count as made by hand, and moved ones are no covers. A null target is a new cluster after the
    user's largest, one for all moves of the user without target. Of two moves of a face from one source the larger target counts."""
    last = rows.groupBy("user_id").agg(F.max("cluster_id").alias("__last"))
    own = moves.join(last, "user_id", "left").withColumn("target", F.coalesce("target", F.coalesce("__last", F.lit(0)) + 1))
    own = tables.single(own.select("user_id", "source", "face_id", "target", "name"), ["user_id", "source", "face_id"])
    left = rows.join(own.select("user_id", F.col("source").alias("cluster_id"), "face_id"), [*KEYS, "face_id"], "left_anti").select(*rows.columns)
    given = own.groupBy("user_id", F.col("target").alias("cluster_id")).agg(F.max(F.expr("nullif(name, '')")).alias("__given"))
    had = left.groupBy(*KEYS).agg(F.max(F.expr("nullif(name, '')")).alias("__had"))
    named = given.join(had, KEYS, "left").select(*KEYS, F.coalesce("__given", "__had").alias("__name"), F.lit(True).alias("__hit"))
    plain = {"representative_type": F.lit(0), "is_user_assigned": F.lit(True)}
    arrived = own.select("user_id", F.col("target").cast(rows.schema["cluster_id"].dataType).alias("cluster_id"), "face_id").distinct()
    arrived = arrived.select(*(F.col(c) if c in (*KEYS, "face_id") else plain.get(c, F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns))
    both = tables.upsert(left, arrived, [*KEYS, "face_id"]).join(named, KEYS, "left")
    hit = F.col("__hit").isNotNull()
    new = {"name": F.when(hit, F.coalesce("__name", "name")).otherwise(F.col("name")), "is_user_assigned": F.when(hit, True).otherwise(F.col("is_user_assigned"))}
    return both.select(*(new[c].alias(c) if c in new else c for c in rows.columns))


def renamed(rows: DataFrame, names: DataFrame) -> DataFrame:
    """All rows of a cluster take its name of ``names`` (user_id, cluster_id, name); a blank one clears it."""
    own = tables.single(names.select(*KEYS, F.coalesce("name", F.lit("")).alias("__new")), KEYS)
    blank = F.expr("nullif(trim(__new), '')")
    return rows.join(own, KEYS, "left").select(*(F.when(F.col("__new").isNull(), F.col(c)).otherwise(blank).alias(c) if c == "name" else c for c in rows.columns))


def covered(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Covers chosen by hand (user_id, cluster_id, face_id; the largest face of a cluster's): the face is of type 2, or stays 1 if it is
    the default; other faces of type 2 are plain again. A choice that is not of the cluster changes nothing."""
    real = rows.select(*KEYS, "face_id").join(chosen.select(*KEYS, "face_id"), [*KEYS, "face_id"], "left_semi")
    pick = real.groupBy(*KEYS).agg(F.max("face_id").alias("__pick"))
    kind = F.col("representative_type")
    new = F.when(F.col("__pick").isNull(), kind).when(F.col("face_id") == F.col("__pick"), F.when(kind == 1, 1).otherwise(2)).when(kind == 2, 0).otherwise(kind)
    return rows.join(pick, KEYS, "left").select(*(new.cast(rows.schema[c].dataType).alias(c) if c == "representative_type" else c for c in rows.columns))


def default_restored(rows: DataFrame, defaults: DataFrame) -> DataFrame:
    """In clusters of ``defaults`` (user_id, cluster_id, face_id; the largest face of a cluster's) no cover is chosen by hand, and that
    face alone is the default; if it is not of the cluster, there is none."""
    pick = defaults.groupBy(*KEYS).agg(F.max("face_id").alias("__pick"))
    new = F.when(F.col("__pick").isNull(), F.col("representative_type")).otherwise((F.col("face_id") == F.col("__pick")).cast("int"))
    return rows.join(pick, KEYS, "left").select(*(new.cast(rows.schema[c].dataType).alias(c) if c == "representative_type" else c for c in rows.columns))


def best_quality(faces: DataFrame) -> DataFrame:
    """(media_id, preferred_face_quality): the best of happy or neutral faces, else of all; null if no face has one."""
    liked = F.lower(F.trim("expression")).isin("happy", "neutral")
    return faces.groupBy("media_id").agg(F.coalesce(F.max(F.when(liked, F.col("quality"))), F.max("quality")).alias("preferred_face_quality"))


#: Steps within which quality, pose, size in pixels and sharpness count as equal; what expressions are worth.
QUALITY_STEP, POSE_STEP, AREA_STEP, SHARPNESS_STEP = 0.05, 0.05, 1000, 0.05
EXPRESSIONS = {"happy": 2, "neutral": 1}


def cover_rank() -> Column:
    """A struct that is largest for the best face of a cluster, from the columns media_type, expression, quality_score, yaw, pitch, bbox
    (left, top, right, bottom), sharpness_score and created_at.

    No video; then expression, quality, pose, size and sharpness in whole steps, so that it is an order (a tolerance between each two
    faces is none); then the latest media, then the smallest face_id. Nulls count as 0, and so does a box that is not of four numbers.
    """
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    step = lambda c, size: F.floor(c / F.lit(float(size)))
    liked = F.coalesce(F.create_map(*(F.lit(x) for kv in EXPRESSIONS.items() for x in kv))[F.col("expression")], F.lit(0))
    pose = F.greatest(F.lit(0.0), 1 - (F.abs(zero("yaw")) / 90 + F.abs(zero("pitch")) / 90) / 2)
    side = lambda a, b: F.col("bbox")[b] - F.col("bbox")[a]
    area = F.coalesce(F.when(F.size("bbox") == 4, side(0, 2) * side(1, 3)), F.lit(0.0)).cast("double")
    return F.struct(
        F.when(F.col("media_type") == "video", 0).otherwise(1).alias("still"), liked.alias("liked"), step(zero("quality_score"), QUALITY_STEP).alias("quality"),
        step(pose, POSE_STEP).alias("pose"), step(area, AREA_STEP).alias("area"), step(zero("sharpness_score"), SHARPNESS_STEP).alias("sharpness"), "created_at", (-F.col("face_id")).alias("id"))


def default_covers(faces: DataFrame) -> DataFrame:
    """(user_id, cluster_id, face_id): each cluster's best face by ``cover_rank``, of those that are no cover by hand if there are any."""
    best = F.max(F.struct((~F.coalesce(F.col("representative_type") == 2, F.lit(False))).alias("free"), cover_rank().alias("rank")))
    return faces.groupBy(*KEYS).agg(best.alias("best")).select(*KEYS, (-F.col("best.rank.id")).alias("face_id"))


def defaults_ensured(rows: DataFrame, faces: DataFrame) -> DataFrame:
    """``rows`` where each cluster without a default cover has the one of ``default_covers`` (faces with the ranked columns)."""
    missing = rows.groupBy(*KEYS).agg(F.max((F.col("representative_type") == 1).cast("int")).alias("has")).where("coalesce(has, 0) = 0").select(*KEYS)
    pick = default_covers(faces).join(missing, KEYS).select(*KEYS, "face_id", F.lit(1).alias("__default"))
    kind = F.coalesce("__default", "representative_type").cast(rows.schema["representative_type"].dataType)
    return rows.join(pick, [*KEYS, "face_id"], "left").select(*(kind.alias(c) if c == "representative_type" else c for c in rows.columns))
