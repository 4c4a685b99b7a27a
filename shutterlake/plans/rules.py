"""Queries on analysis results, what is tried again, and albums: each step's own rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.operators import lifecycle
from shutterlake.plans.queries import Query
from shutterlake.sources.views import base, duck, view
from shutterlake.streaming import analysis

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


_FACE = "named_struct('face_index', {i}, 'quality_score', {q}, 'expression', {e}, 'is_high_quality', {h}, 'embedding', {v}, 'expression_confidence', {c}, 'confidence', 0.25D)"
_FACES = f"array({_FACE.format(i=0, q='(id % 10) / 10.0D', e=chr(39) + 'Happy ' + chr(39), h='id % 3 = 0', v='array(1.0F, 2.0F)', c='CAST(NULL AS DOUBLE)')}, {_FACE.format(i=1, q='(id % 11) / 10.0D', e='CAST(NULL AS STRING)', h='true', v='CAST(array() AS ARRAY<FLOAT>)', c='0.5D')})"
_BODY = f"""CASE WHEN id % 31 = 0 THEN '{{not json' ELSE to_json(named_struct(
'caption', named_struct('status', CASE WHEN id % 5 = 0 THEN 'failed' ELSE 'success' END, 'data', named_struct('description', CASE WHEN id % 6 = 0 THEN '   ' ELSE concat('  day ', id, ' ') END,
  'keywords', array(' a ', 'a', '', concat('k', id % 3)), 'scene_tags', array(' '), 'ocr', CASE WHEN id % 4 = 0 THEN ' ' ELSE concat('T', id) END, 'face_count', CASE WHEN id % 7 = 0 THEN id % 5 - 1.5D END)),
'quality', named_struct('status', CASE WHEN id % 8 = 0 THEN 'failed' ELSE 'success' END, 'data', named_struct('hashes', named_struct('phash', concat('p', id)), 'sharpness_score', (id % 1000) / 777.0D)),
'person', named_struct('status', CASE WHEN id % 9 = 1 THEN 'failed' ELSE 'success' END, 'data', named_struct('face_count', CAST(id % 4 AS INT), 'faces', {_FACES},
  'summary', named_struct('expressions', array(concat('a', id % 2), 'b'), 'genders', array(' ')))))) END"""


def responses(s: SparkSession, d: str) -> DataFrame:
    """(id, media_type, body) for each of the media."""
    return view(s, d, "media").select("id", "media_type", F.expr(_BODY).alias("body"))


_R = """, m AS (SELECT *, media_type = 'video' AS video, id % 31 <> 0 AND id % 5 <> 0 AS cap, id % 31 <> 0 AND id % 8 <> 0 AND media_type <> 'video' AS q, id % 31 <> 0 AND id % 9 <> 1 AS per FROM media),
r AS (SELECT id, CASE WHEN cap THEN 'success' ELSE 'failed' END AS cloud, CASE WHEN cap AND id % 6 <> 0 THEN 'day ' || id END AS description, CASE WHEN cap THEN 'a|k' || (id % 3) END AS keywords,
  CASE WHEN cap AND id % 4 <> 0 THEN 'T' || id END AS ocr, CASE WHEN q THEN 'p' || id END AS phash, CASE WHEN cap AND id % 7 = 0 THEN greatest(0, floor(id % 5 - 1.5)) WHEN per THEN id % 4 END AS face_count,
  CASE WHEN per THEN 0 END AS person_count, CASE WHEN per THEN (id % 10) / 10 END AS preferred_face_quality, CASE WHEN per THEN 'a' || (id % 2) || ',b' END AS expression_tags,
  CASE WHEN q THEN round((id % 1000) / 777, 2) END AS sharpness_score, per AND (video OR q) AS primary_ok, CASE WHEN NOT per THEN 0 WHEN video THEN 1 ELSE 1 + CAST(id % 3 = 0 AS INT) END AS clusterable FROM m)
"""
_SHOWN = ["id", "cloud", "description", "ocr", "phash", "face_count", "person_count", "preferred_face_quality", "expression_tags", "sharpness_score", "primary_ok", "clusterable"]
_add("analysis_merged", lambda s, d: analysis.merged(responses(s, d)).select(*_SHOWN, F.array_join("keywords", "|").alias("keywords")), duck("media") + _R + f"SELECT {', '.join(_SHOWN)}, keywords FROM r")
_add("analysis_faces", lambda s, d: analysis.faces_of(responses(s, d)).select("media_id", "source_type", "face_index", "quality_score", "confidence", F.size("embedding").alias("length")),
     duck("media") + _R + """SELECT id AS media_id, CASE WHEN video THEN 'video' ELSE 'image' END AS source_type, i AS face_index, CASE i WHEN 0 THEN (id % 10) / 10 ELSE (id % 11) / 10 END AS quality_score,
CASE i WHEN 0 THEN 0.25 ELSE 0.5 END AS confidence, CASE i WHEN 0 THEN 2 ELSE 0 END AS length FROM m, (SELECT unnest([0, 1]) AS i) WHERE per AND CASE WHEN video THEN i = 0 ELSE i = 1 OR id % 3 = 0 END""")  # fmt: skip


def _table(s: SparkSession, d: str) -> DataFrame:
    none = {c: F.lit(None).cast("string") for c in ("phash", "dhash", "age_tags", "gender_tags", "analysis_status_cloud", "ai_description", "ai_ocr")}
    return view(s, d, "media").withColumns(none)


_FINAL = ["id", "analysis_status_primary", "analysis_status_cloud", "face_count", "person_count", "preferred_face_quality", "expression_tags", "sharpness_score", "phash", "ai_description", "ai_ocr"]
_add("analysis_finalised", lambda s, d: analysis.finalised(_table(s, d), responses(s, d).where("id % 4 > 0")).select(*_FINAL),
     duck("media") + _R + """SELECT media.id, CASE WHEN r.id IS NULL THEN analysis_status_primary ELSE 'success' END AS analysis_status_primary, r.cloud AS analysis_status_cloud, coalesce(r.face_count, media.face_count) AS face_count,
coalesce(r.person_count, media.person_count) AS person_count, coalesce(r.preferred_face_quality, media.preferred_face_quality) AS preferred_face_quality, coalesce(r.expression_tags, media.expression_tags) AS expression_tags,
coalesce(r.sharpness_score, media.sharpness_score) AS sharpness_score, r.phash, r.description AS ai_description, r.ocr AS ai_ocr FROM media LEFT JOIN r ON r.id = media.id AND r.id % 4 > 0""")  # fmt: skip


def _failures(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "media").withColumns({
        "meta_pipeline_status": F.when(F.col("id") % 10 == 0, "failed"), "analysis_status_cloud": F.when(F.col("id") % 6 == 1, "failed").when(F.col("id") % 6 == 2, "skipped"),
        "map_regeo_status": F.when(F.col("id") % 4 == 1, "skipped").when(F.col("id") % 4 == 2, "failed"), "gps_latitude": F.when(F.col("id") % 3 > 0, 1.5), "gps_longitude": F.lit(2.5)})


_FAILED = duck("media") + """, f AS (SELECT user_id, id, created_at, 'ingest' AS stage FROM media WHERE deleted_at IS NULL AND id % 10 = 0
UNION ALL SELECT user_id, id, created_at, 'primary' FROM media WHERE deleted_at IS NULL AND analysis_status_primary = 'failed' UNION ALL SELECT user_id, id, created_at, 'cloud' FROM media WHERE deleted_at IS NULL AND id % 6 = 1)
"""
_add("retry_targets", lambda s, d: analysis.retry_targets(_failures(s, d), analysis.retry_stages("all", True)),
     _FAILED + "SELECT user_id, id, stage FROM f QUALIFY row_number() OVER (PARTITION BY user_id, stage ORDER BY created_at DESC, id DESC) <= CASE stage WHEN 'cloud' THEN 200000 ELSE 500 END")
_add("retry_targets_of", lambda s, d: analysis.retry_targets(_failures(s, d), analysis.retry_stages(None, False), view(s, d, "media").where("id % 7 = 0").select("id")),
     _FAILED + "SELECT user_id, id, stage FROM f WHERE stage <> 'cloud' AND id % 7 = 0 QUALIFY row_number() OVER (PARTITION BY user_id, stage ORDER BY created_at DESC, id DESC) <= 500")
_add("geocode_backlog", lambda s, d: analysis.backlog(_failures(s, d), "geocode", 900, 100), duck("media") + "SELECT id FROM media WHERE deleted_at IS NULL AND id % 4 IN (1, 2) AND id % 3 > 0 AND id < 900 ORDER BY id DESC LIMIT 100")
_add("caption_backlog", lambda s, d: analysis.backlog(_failures(s, d), "cloud"), duck("media") + "SELECT id FROM media WHERE deleted_at IS NULL AND id % 6 IN (1, 2) AND analysis_status_primary = 'success' ORDER BY id DESC LIMIT 500")


def _albums(s: SparkSession, d: str) -> DataFrame:
    """Albums are made, get covers by hand, lose media, and those touched are counted anew."""
    own = base(s, d, "supplier").selectExpr("s_suppkey AS id", "s_suppkey % 5 AS user_id", "s_name AS name", "CAST(NULL AS BIGINT) AS cover_media_id", "0L AS media_count", "0L AS created_at", "0L AS updated_at", "CAST(NULL AS BIGINT) AS deleted_at")
    edges, media = view(s, d, "album_media"), view(s, d, "media")
    wanted = own.selectExpr("id + 1000000 AS id", "user_id", "CASE WHEN id % 2 = 0 THEN name WHEN id % 9 = 0 THEN '  ' ELSE concat(' New ', id % 4, ' ') END AS name")
    made = lifecycle.albums_created(own, wanted, 7)
    by_hand = edges.groupBy(F.col("album_id").alias("id")).agg(F.when(F.col("id") % 4 == 0, F.max("media_id") + 1).otherwise(F.min(F.when(F.col("media_id") % 3 == 0, F.col("media_id")))).alias("cover_media_id"))
    covered = lifecycle.covers_set(made, edges, media, by_hand)
    left, touched = lifecycle.removed(edges, edges.where("media_id % 5 = 0 AND album_id % 3 > 0"))
    return lifecycle.albums_refreshed(covered, left, media, touched).select("id", "user_id", "name", "cover_media_id", "media_count", "created_at")


_add("album_flow", _albums, duck("media", "album_media") + """, w AS (SELECT min(s_suppkey) + 1000000 AS id, s_suppkey % 5 AS user_id, 'New ' || (s_suppkey % 4) AS name FROM supplier WHERE s_suppkey % 2 = 1 AND s_suppkey % 9 <> 0 GROUP BY 2, 3),
a AS (SELECT s_suppkey AS id, s_suppkey % 5 AS user_id, s_name AS name, 0 AS created_at FROM supplier UNION ALL SELECT id, user_id, name, 7 FROM w),
h AS (SELECT album_id AS id, CASE WHEN album_id % 4 = 0 THEN max(media_id) + 1 ELSE min(media_id) FILTER (media_id % 3 = 0) END AS cover FROM album_media GROUP BY album_id),
e AS (SELECT album_media.* FROM album_media JOIN media ON media.id = media_id AND deleted_at IS NULL),
c AS (SELECT h.id, h.cover FROM h JOIN e ON e.album_id = h.id AND e.media_id = h.cover),
t AS (SELECT DISTINCT album_id AS id FROM album_media WHERE media_id % 5 = 0 AND album_id % 3 > 0),
l AS (SELECT * FROM e WHERE NOT (media_id % 5 = 0 AND album_id % 3 > 0)),
n AS (SELECT album_id AS id, count(*) AS n, arg_max(media_id, {'a': added_at, 'm': media_id}) AS latest FROM l GROUP BY album_id)
SELECT a.id, a.user_id, a.name, CASE WHEN t.id IS NULL THEN c.cover WHEN EXISTS (SELECT 1 FROM l WHERE l.album_id = a.id AND l.media_id = c.cover) THEN c.cover ELSE n.latest END AS cover_media_id,
CASE WHEN t.id IS NULL THEN 0 ELSE coalesce(n.n, 0) END AS media_count, a.created_at FROM a LEFT JOIN c ON c.id = a.id LEFT JOIN t ON t.id = a.id LEFT JOIN n ON n.id = a.id""")
