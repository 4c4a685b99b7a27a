"""Queries on files, kept rankings and groups, replaced rows and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions import codec, formats
from shutterlake.operators import neighbours, ranked, rollups
from shutterlake.plans.queries import _LIVE, _QUERY, _SIM, Query, _live, _vectors
from shutterlake.sources import versions
from shutterlake.sources.shared import folder
from shutterlake.sources.views import base, duck, view
from shutterlake.streaming import state

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


# ---- names with extensions; every fiftieth file has a number of its own
_NAME = "CASE WHEN id % 50 = 0 THEN concat({place}, '_', CAST(id % 7 + 1 AS {str})) ELSE {place} END"
_NAME = "concat(" + _NAME + ", CASE WHEN media_type = 'video' THEN '.mp4' WHEN id % 8 = 0 THEN '' ELSE '.jpg' END)"
_PLACE = "coalesce(nullif(trim(city), ''), nullif(trim(province), ''), 'unknown')"
_NUMBERED = r"(?s)^(.+)_([0-9]{1,9})(\.[^.]*)?$"
_STEM = r"(?s)^(.+?)(\.[^.]*)?$"
_add("export_file_names", lambda s, d: rollups.numbered_names(_live(s, d).select("id", F.expr(_NAME.format(place=_PLACE, str="STRING")).alias("name"))),
     _LIVE + f""", f AS (SELECT id, {_NAME.format(place=_PLACE, str='VARCHAR')} AS name FROM live), n AS (SELECT id, name, row_number() OVER (PARTITION BY name ORDER BY id) - 1 AS k FROM f),
l AS (SELECT regexp_extract(name, '{_NUMBERED}', 1) || regexp_extract(name, '{_NUMBERED}', 3) AS own, max(CAST(regexp_extract(name, '{_NUMBERED}', 2) AS BIGINT)) AS m FROM f WHERE regexp_matches(name, '{_NUMBERED}') GROUP BY 1)
SELECT id, name, CASE WHEN k = 0 THEN name ELSE regexp_extract(name, '{_STEM}', 1) || '_' || CAST(k + coalesce(m, 0) AS VARCHAR) || regexp_extract(name, '{_STEM}', 2) END AS unique_name FROM n LEFT JOIN l ON own = name""")  # fmt: skip

# ---- vectors from blobs, files by their bytes
_add("vector_blob_topk", lambda s, d: neighbours.most_alike(codec.decoded(codec.encoded(_vectors(s, d))), _QUERY, 0.05, 25).select("id", F.round("similarity", 6).alias("similarity")),
     f"SELECT vec_id AS id, round({_SIM}, 6) AS similarity FROM embeddings WHERE {_SIM} >= 0.05 ORDER BY round({_SIM}, 9) DESC, vec_id DESC LIMIT 25")
#: First bytes that pages get, and the format that they then have.
_HEADS = [("FFD8FF", "jpeg"), ("89504E470D0A1A0A", "png"), ("474946383961", "gif"), ("424D", "bmp"), ("49492A00", "tiff"), ("524946460000000057454250", "webp"), ("000000186674797068656963", "heic"), ("000000186674797061766966", "avif"), ("3C737667", "svg"), ("474946383861", None), ("", None)]
_HEAD = "CASE page_id % 11 " + " ".join(f"WHEN {k} THEN '{h}'" for k, (h, _) in enumerate(_HEADS)) + " END"
_add("content_formats", lambda s, d: base(s, d, "pages").select("page_id", F.concat(F.unhex(F.expr(_HEAD)), F.encode("html", "UTF-8")).alias("content")).select("page_id", formats.image_format(F.col("content")).alias("format"), formats.content_hash(F.col("content")).alias("hash")),
     "SELECT page_id, CASE page_id % 11 " + " ".join(f"WHEN {k} THEN '{f}'" for k, (_, f) in enumerate(_HEADS) if f) + f" ELSE CASE WHEN contains(left(html, 94), '<svg') OR contains(left(html, 94), '<?xml') THEN 'svg' END END AS format, sha256(unhex({_HEAD}) || encode(html)) AS hash FROM pages")


# ---- a kept ranking, of which a third vanishes
def _ranked(s: SparkSession, d: str) -> DataFrame:
    path = folder(s)
    ranked.keep(view(s, d, "media").select("id", "sharpness_score"), [F.desc("sharpness_score"), F.col("id")], path)
    return ranked.page(s, path, "id bigint, sharpness_score double", view(s, d, "media").where("id % 3 > 0"), 400, 50)


_add("ranked_page", _ranked, duck("media") + "SELECT id, sharpness_score, place FROM (SELECT id, sharpness_score, row_number() OVER (ORDER BY sharpness_score DESC, id) - 1 AS place FROM media) WHERE place >= 400 AND id % 3 > 0 ORDER BY place LIMIT 50")

# ---- covers by tolerances
_FACE = """vec_id AS face_id, CAST(vec_id % 5 AS BIGINT) AS user_id, CAST(label AS BIGINT) AS cluster_id, CASE WHEN vec_id % 6 = 0 THEN 'video' ELSE 'image' END AS media_type,
  CASE vec_id % 3 WHEN 0 THEN 'happy' WHEN 1 THEN 'neutral' ELSE 'sad' END AS expression, CAST(vec_id * 37 % 101 AS DOUBLE) / 100 AS quality_score, CAST(vec_id * 7 % 90 AS DOUBLE) AS yaw,
  CAST(vec_id * 3 % 60 AS DOUBLE) AS pitch, CAST(40 + vec_id % 50 AS DOUBLE) AS w, CAST(50 + vec_id % 30 AS DOUBLE) AS h, CAST(vec_id * 53 % 103 AS DOUBLE) / 102 AS sharpness_score, vec_id * 11 % 997 AS created_at"""


def _faces(s: SparkSession, d: str) -> DataFrame:
    return base(s, d, "embeddings").selectExpr(*(x.strip() for x in _FACE.replace("\n", " ").split(", ") if x)).withColumn("bbox", F.array(F.lit(0.0), F.lit(0.0), F.col("w"), F.col("h")))


_BEATS = "CASE WHEN a.v <> b.v THEN b.v < a.v WHEN a.l <> b.l THEN b.l > a.l WHEN abs(a.q - b.q) > 0.05 THEN b.q > a.q WHEN abs(a.p - b.p) > 0.05 THEN b.p > a.p WHEN abs(a.s - b.s) > 1000 THEN b.s > a.s WHEN abs(a.x - b.x) > 0.05 THEN b.x > a.x ELSE b.t > a.t END"
_add("tolerant_covers", lambda s, d: ranked.tolerant_covers(_faces(s, d)),
     f"""WITH f AS (SELECT user_id, cluster_id, {{'i': face_id, 'v': CASE WHEN media_type = 'video' THEN 1 ELSE 0 END, 'l': CASE expression WHEN 'happy' THEN 2 WHEN 'neutral' THEN 1 ELSE 0 END, 'q': quality_score,
'p': greatest(0.0, 1 - (yaw / 90 + pitch / 90) / 2), 's': w * h, 'x': sharpness_score, 't': created_at}} AS f FROM (SELECT {_FACE} FROM embeddings)),
t AS (SELECT user_id, cluster_id, f.i // 4096 AS tile, list_reduce(list(f ORDER BY f.i), lambda a, b: CASE WHEN {_BEATS} THEN b ELSE a END) AS f FROM f GROUP BY 1, 2, 3),
u AS (SELECT user_id, cluster_id, f.i // 16777216 AS tile, list_reduce(list(f ORDER BY f.i), lambda a, b: CASE WHEN {_BEATS} THEN b ELSE a END) AS f FROM t GROUP BY 1, 2, 3)
SELECT user_id, cluster_id, list_reduce(list(f ORDER BY f.i), lambda a, b: CASE WHEN {_BEATS} THEN b ELSE a END).i AS face_id FROM u GROUP BY 1, 2""")  # fmt: skip


# ---- groups of like media
def _groups(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "album_media").select(F.col("album_id").alias("group_id"), F.col("media_id").alias("id"), (F.col("media_id") * 7 % 1000).cast("double").alias("rank_score"), F.lit(1.0).alias("similarity"))


_GROUPS = duck("media", "album_media") + ", g AS (SELECT album_id AS group_id, media_id AS id, CAST(media_id * 7 % 1000 AS DOUBLE) AS rank_score, 1.0 AS similarity FROM album_media)\n"
_SHOWN = ", m AS (SELECT g.*, count(*) OVER (PARTITION BY group_id) AS n, row_number() OVER (PARTITION BY group_id ORDER BY rank_score DESC, g.id) > 1 AS recommended FROM g JOIN media ON media.id = g.id AND deleted_at IS NULL)\n"
_add("similar_group_page", lambda s, d: ranked.group_page(_groups(s, d), _live(s, d), 2, 3).select("group_id", "id", "rank_score", "n", "recommended"),
     _GROUPS + _SHOWN + "SELECT group_id, id, rank_score, n, recommended FROM m WHERE n >= 2 AND group_id IN (SELECT group_id FROM (SELECT DISTINCT group_id, n FROM m WHERE n >= 2) ORDER BY n DESC, group_id LIMIT 3 OFFSET 3)")


def _deleted(s: SparkSession, d: str) -> DataFrame:
    groups = _groups(s, d).where("id % 40 = group_id % 40")
    left, gone = ranked.deleted_in_group(groups, 3, [43, 83, 123, 163, 4])
    return left.select("group_id", "id").unionByName(gone.select(F.lit(None).cast("bigint").alias("group_id"), "id"))


_add("similar_group_delete", _deleted, _GROUPS + """, h AS (SELECT * FROM g WHERE id % 40 = group_id % 40), x AS (SELECT DISTINCT id FROM h WHERE group_id = 3 AND id IN (43, 83, 123, 163, 4)),
y AS (SELECT group_id, id, count(*) OVER (PARTITION BY group_id) AS n FROM h WHERE id NOT IN (SELECT id FROM x)) SELECT group_id, id FROM y WHERE n > 1 UNION ALL SELECT NULL, id FROM x""")


# ---- rows replaced owner by owner
def _replaced(s: SparkSession, d: str) -> DataFrame:
    """All users' rows, then those of two users anew, then none for one of them."""
    path, rows = folder(s), view(s, d, "media").select("user_id", "id", "city")
    owners = rows.select("user_id").distinct()
    versions.replace(path, rows, owners, 0)
    versions.replace(path, rows.where("id % 2 = 0").withColumn("city", F.upper("city")), owners.where("user_id IN (1, 2)"), 1)
    versions.replace(path, rows.limit(0), owners.where("user_id = 2"), 2)
    return versions.current(s, path, "user_id bigint, id bigint, city string", "user_id")


_add("replaced_rows", _replaced, duck("media") + "SELECT user_id, id, city FROM media WHERE user_id NOT IN (1, 2) UNION ALL SELECT user_id, id, upper(city) FROM media WHERE user_id = 1 AND id % 2 = 0")

# ---- sessions and uploads
_add("upload_sessions", lambda s, d: state.sessions(base(s, d, "events").select("user_id", "event_id", "ts", (F.col("event_type") == "signup").alias("begins"))).withColumns({c: F.unix_micros(c) for c in ("started", "ended")}),
     """WITH s AS (SELECT user_id, event_id AS session, ts AS started, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events WHERE event_type = 'signup'),
e AS (SELECT *, CASE WHEN nxt < started + INTERVAL 1 DAY THEN nxt ELSE started + INTERVAL 1 DAY END AS ended FROM s)
SELECT e.user_id, session, epoch_us(started) AS started, epoch_us(ended) AS ended, count(*) AS events, CASE WHEN nxt < started + INTERVAL 1 DAY THEN 'replaced' ELSE 'expired' END AS how
FROM e JOIN events v ON v.user_id = e.user_id AND (v.ts > e.started OR v.ts = e.started AND v.event_id >= session) AND v.ts < ended GROUP BY ALL""")  # fmt: skip
_KINDS = "CASE event_type WHEN 'signup' THEN 'stored' WHEN 'error' THEN 'trashed' WHEN 'purchase' THEN 'removed' ELSE 'upload' END"


def uploads(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events on hashes, and the table that they begin with."""
    events = base(s, d, "events").select("user_id", F.expr("CAST(event_id % 7 AS STRING)").alias("hash"), "event_id", "ts", F.expr(_KINDS).alias("kind"))
    media = base(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.expr("CAST(c_custkey % 3 AS STRING)").alias("hash"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN 1L END").alias("deleted_at"))
    return events, media


#: A machine of states is not SQL; a plain walk is in the tests.
_add("kept_upload_routes", lambda s, d: state.deduplicated(*uploads(s, d)).select("user_id", "hash", "event_id", "route"))
