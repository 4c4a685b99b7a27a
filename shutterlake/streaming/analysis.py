"""What analysis of media gives back: JSON bodies of modules merged into the table, their faces, and what is to be tried again.

A body is parsed once; everything else is columns of it. The same functions take streams (merging and faces) and tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.operators import tables

_FACE = "struct<face_index:int,embedding:array<float>,age:int,gender:string,expression:string,expression_confidence:double,confidence:double,quality_score:double,bbox:array<double>,pose:struct<yaw:double,pitch:double>,is_high_quality:boolean>"
_CAPTION = "struct<description:string,keywords:array<string>,subject_tags:array<string>,action_tags:array<string>,scene_tags:array<string>,ocr:string,face_count:double,person_count:double>"
_QUALITY = "struct<hashes:struct<phash:string,dhash:string>,sharpness_score:double>"
_PERSON = f"struct<face_count:int,person_count:int,faces:array<{_FACE}>,summary:struct<expressions:array<string>,ages:array<string>,genders:array<string>>>"
BODY = ", ".join(f"{name} struct<status:string,data:{data}>" for name, data in (("caption", _CAPTION), ("quality", _QUALITY), ("person", _PERSON)))
#: Text columns of a caption and the columns of the table that they set.
CAPTION_FIELDS = {"description": "ai_description", "keywords": "ai_keywords", "subject_tags": "ai_subject_tags", "action_tags": "ai_action_tags", "scene_tags": "ai_scene_tags", "ocr": "ai_ocr"}
MEASURES = ["phash", "dhash", "face_count", "person_count", "preferred_face_quality", "expression_tags", "age_tags", "gender_tags", "sharpness_score"]
#: Failed media that one call takes up again, of a user and stage.
RETRIES, CLOUD_RETRIES = 500, 200_000
STAGES = {"ingest": "meta_pipeline_status", "primary": "analysis_status_primary", "cloud": "analysis_status_cloud"}


def _text(c: Column) -> Column:
    """Without outer blanks; null if nothing is left."""
    own = F.trim(c)
    return F.when(own != "", own)


def _tags(c: Column) -> Column:
    """Trimmed, each once, without empty ones; null if none is left."""
    own = F.array_distinct(F.filter(F.transform(c, lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != "")))
    return F.when(F.size(own) > 0, own)


def _count(c: Column) -> Column:
    return F.when(c.isNotNull() & ~F.isnan(c), F.greatest(F.lit(0), F.floor(c)).cast("int"))


def _joined(c: Column) -> Column:
    return _text(F.array_join(F.filter(c, lambda t: t.isNotNull()), ","))


def _clusterable(video: Column, faces: Column) -> Column:
    """Faces to cluster: of a video those with a vector, of an image those of high quality."""
    return F.filter(faces, lambda f: F.when(video, F.coalesce(F.size(f["embedding"]) > 0, F.lit(False))).otherwise(F.coalesce(f["is_high_quality"], F.lit(False))))


def _parsed(responses: DataFrame) -> DataFrame:
    own = responses.select("id", (F.col("media_type") == "video").alias("video"), F.from_json("body", BODY).alias("b"))
    return own.select("id", F.coalesce("video", F.lit(False)).alias("video"), "b.*")


def merged(responses: DataFrame, cloud_enabled: bool = True) -> DataFrame:
    """(id, cloud, CAPTION_FIELDS, MEASURES, primary_ok, clusterable) of responses (id, media_type, body).

    A module that is missing, not a success or no JSON gives nulls; counts of a successful caption come before those of the person
    module; a video has no quality module. The best face is that of the happy or neutral ones, else of all. cloud: skipped where the
    cloud is off, else whether the caption was a success.
    """
    b = _parsed(responses)
    ok = lambda m: F.coalesce(F.col(f"{m}.status") == "success", F.lit(False))
    data = lambda m, c: F.when(ok(m), F.col(f"{m}.data.{c}"))
    caption = [_text(data("caption", c)).alias(c) if c in ("description", "ocr") else _tags(data("caption", c)).alias(c) for c in CAPTION_FIELDS]
    image = lambda c: F.when(~F.col("video"), c)
    faces = data("person", "faces")
    finite = lambda f: f["quality_score"].isNotNull() & ~F.isnan(f["quality_score"])
    best = lambda some: F.array_max(F.transform(F.filter(faces, lambda f: some(f) & finite(f)), lambda f: f["quality_score"]))
    liked = lambda f: F.coalesce(F.lower(F.trim(f["expression"])).isin("happy", "neutral"), F.lit(False))
    has_person = ok("person") & F.col("person.data").isNotNull()
    counts = {c: F.coalesce(_count(data("caption", c)), F.when(has_person, F.coalesce(F.col(f"person.data.{c}"), F.lit(0)))) for c in ("face_count", "person_count")}
    summary = lambda c: _joined(data("person", f"summary.{c}"))
    cloud = F.when(ok("caption"), "success").otherwise("failed") if cloud_enabled else F.lit("skipped")
    return b.select(
        "id", cloud.alias("cloud"), *caption, image(data("quality", "hashes.phash")).alias("phash"), image(data("quality", "hashes.dhash")).alias("dhash"), *(v.alias(k) for k, v in counts.items()),
        F.coalesce(best(liked), best(lambda f: F.lit(True))).alias("preferred_face_quality"), summary("expressions").alias("expression_tags"), summary("ages").alias("age_tags"), summary("genders").alias("gender_tags"),
        image(F.round(data("quality", "sharpness_score"), 2)).alias("sharpness_score"), (ok("person") & (F.col("video") | ok("quality"))).alias("primary_ok"),
        F.coalesce(F.size(_clusterable(F.col("video"), faces)), F.lit(0)).alias("clusterable"))


def faces_of(responses: DataFrame) -> DataFrame:
    """(media_id, source_type, face_index, embedding, age, gender, expression, confidence, quality_score, bbox, pose) of faces to cluster."""
    b = _parsed(responses).where("person.status = 'success'")
    own = b.select(F.col("id").alias("media_id"), F.when(F.col("video"), "video").otherwise("image").alias("source_type"), F.explode(_clusterable(F.col("video"), F.col("person.data.faces"))).alias("f"))
    f = [F.col(f"f.{c}").alias(c) for c in ("face_index", "embedding", "age", "gender", "expression")]
    return own.select("media_id", "source_type", *f, F.coalesce("f.expression_confidence", "f.confidence").alias("confidence"), "f.quality_score", F.coalesce("f.bbox", F.array().cast("array<double>")).alias("bbox"), "f.pose")


def faces_replaced(faces: DataFrame, responses: DataFrame) -> DataFrame:
    """The table of faces where media with new faces have these instead of those of the same source; others keep theirs."""
    return tables.replace(faces, faces_of(responses).select(*faces.columns), ["media_id", "source_type"])


def finalised(media: DataFrame, responses: DataFrame, cloud_enabled: bool = True) -> DataFrame:
    """``media`` (id, analysis_status_primary, analysis_status_cloud, MEASURES and the columns of CAPTION_FIELDS) after responses: states are
    set, measures and captions where there is a new value; media without a response stay as they are."""
    new = tables.single(merged(responses, cloud_enabled).drop("primary_ok", "clusterable").withColumnsRenamed(CAPTION_FIELDS).withColumn("__met", F.lit(True)), ["id"])
    own = {c: f"__new_{c}" for c in new.columns if c != "id"}
    joined = media.join(new.withColumnsRenamed(own), "id", "left")
    met = F.col("__new___met").isNotNull()
    out = []
    for c in media.columns:
        if c == "analysis_status_primary":
            out.append(F.when(met, "success").otherwise(F.col(c)).alias(c))
        elif c == "analysis_status_cloud":
            out.append(F.coalesce("__new_cloud", c).alias(c))
        else:
            out.append(F.coalesce(own[c], c).alias(c) if c in own else F.col(c))
    return joined.select(*out)


def retry_stages(stage: str | None, cloud_ready: bool) -> list[str]:
    """The stages that a call takes up again: all for null or "all"; the cloud's only if it is ready, which is an error where it was asked for."""
    if stage not in (None, "all", *STAGES):
        raise ValueError(f"no such stage: {stage}")
    if stage == "cloud" and not cloud_ready:
        raise ValueError("the cloud model is off")
    return [s for s in ([*STAGES] if stage in (None, "all") else [stage]) if s != "cloud" or cloud_ready]


def retry_targets(media: DataFrame, stages: list[str], ids: DataFrame | None = None) -> DataFrame:
    """(user_id, id, stage) of live media that failed in ``stages``, of ``ids`` (id) only if given: of a user and stage the latest RETRIES, of
    the cloud's CLOUD_RETRIES. A limit of each user is kept in tasks first, so a user with many failures sends few rows."""
    live = media.where("deleted_at IS NULL")
    live = live if ids is None else live.join(ids.select("id").distinct(), "id", "left_semi")
    each = F.explode(F.array_compact(F.array(*(F.when(F.col(STAGES[s]) == "failed", F.lit(s)) for s in stages)))).alias("stage")
    rank = F.row_number().over(Window.partitionBy("user_id", "stage").orderBy(F.desc("created_at"), F.desc("id")))
    failed = live.select("user_id", "id", "created_at", each)
    parts = [failed.where("stage <> 'cloud'").withColumn("__k", rank).where(F.col("__k") <= RETRIES), failed.where("stage = 'cloud'").withColumn("__k", rank).where(F.col("__k") <= CLOUD_RETRIES)]
    return reduce(DataFrame.unionByName, parts).select("user_id", "id", "stage")


def backlog(media: DataFrame, stage: str, after: int | None = None, size: int = 500) -> DataFrame:
    """A page (id) of live media that are to be filled in later: by falling id, those below ``after``. cloud: skipped or failed captions of
    analysed media; geocode: skipped or failed places of media with coordinates."""
    own = {"cloud": F.col("analysis_status_cloud").isin("skipped", "failed") & (F.col("analysis_status_primary") == "success"), "geocode": F.col("map_regeo_status").isin("skipped", "failed") & F.col("gps_latitude").isNotNull() & F.col("gps_longitude").isNotNull()}
    rows = media.where(F.col("deleted_at").isNull() & own[stage])
    return (rows if after is None else rows.where(F.col("id") < after)).select("id").orderBy(F.desc("id")).limit(size)
