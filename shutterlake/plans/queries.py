"""Queries over the test tables, each with DuckDB SQL that must give the same rows (but where SQL can't express it)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions import geo, media, vectors
from shutterlake.operators import filters, neighbours, rollups, search, tables
from shutterlake.sources.views import base, duck, live, view
from shutterlake.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _live(s: SparkSession, d: str) -> DataFrame:
    return live(view(s, d, "media"))


_LIVE = duck("media") + ", live AS (SELECT *, coalesce(nullif(trim(city), ''), nullif(trim(province), ''), nullif(trim(country), '')) AS place FROM media WHERE deleted_at IS NULL)\n"
_HAPPY = "list_contains(string_split(replace(coalesce(expression_tags, ''), ' ', ''), ','), '{}')"
_COVER = f"CASE WHEN face_count > 0 AND {_HAPPY.format('happy')} THEN 1 WHEN face_count > 0 AND {_HAPPY.format('neutral')} THEN 2 WHEN face_count > 0 THEN 3 WHEN person_count > 0 THEN 4 ELSE 5 END, preferred_face_quality DESC, face_count DESC, person_count DESC, captured_at DESC NULLS LAST, id DESC"


def _groups_sql(key: str) -> str:
    return _LIVE + f"SELECT user_id, key, n, id AS cover_id FROM (SELECT user_id, {key} AS key, id, count(*) OVER (PARTITION BY user_id, {key}) AS n, row_number() OVER (PARTITION BY user_id, {key} ORDER BY {_COVER}) AS rn FROM live) WHERE rn = 1"


for _k in ("year", "month", "date"):
    _add(f"timeline_groups_{_k}", lambda s, d, k=_k: rollups.groups(_live(s, d), F.col(f"{k}_key")), _groups_sql(f"{_k}_key"))
_add("location_groups", lambda s, d: rollups.groups(_live(s, d), F.coalesce(media.place(), F.lit("unknown"))), _groups_sql("coalesce(place, 'unknown')"))

for _k, _key in {"city": "coalesce(place, 'unknown')", "year": "year_key", "month": "month_key", "weekday": "day_key"}.items():
    _add(f"facet_{_k}", lambda s, d, k=_k, key=_key: rollups.facet(_live(s, d), F.coalesce(media.place(), F.lit("unknown")) if k == "city" else F.col(key)), _LIVE + f"SELECT {_key} AS key, count(*) AS n FROM live GROUP BY 1")

_add("timeline_items_page", lambda s, d: filters.page(_live(s, d).where("user_id = 1 AND year_key = '1995'"), [F.col("captured_at").desc(), F.col("id").desc()], 2, 20).select("id", "month_key"),
     _LIVE + "SELECT id, month_key FROM live WHERE user_id = 1 AND year_key = '1995' ORDER BY captured_at DESC, id DESC LIMIT 20 OFFSET 20")
_add("keyset_page", lambda s, d: filters.after(_live(s, d).where("analysis_status_primary IS NULL"), 900, 50).select("id"), _LIVE + "SELECT id FROM live WHERE analysis_status_primary IS NULL AND id < 900 ORDER BY id DESC LIMIT 50")
_add("failed_page", lambda s, d: filters.page(_live(s, d).where("analysis_status_primary = 'failed'"), [F.col("created_at").desc(), F.col("id").desc()], 1, 100).select("id"),
     _LIVE + "SELECT id FROM live WHERE analysis_status_primary = 'failed' ORDER BY created_at DESC, id DESC LIMIT 100")

#: name: (filters, the same in SQL)
_FILTERS: dict[str, tuple[dict, str]] = {
    "location": ({"location": ["ASIA", "FRANCE", "unknown"]}, "place IN ('ASIA', 'FRANCE') OR place IS NULL"),
    "tags_any": ({"expression": ["happy", "neutral"]}, f"{_HAPPY.format('happy')} OR {_HAPPY.format('neutral')}"),
    "media_type": ({"media_type": "video"}, "media_type = 'video'"),
    "year_month": ({"year": ["1994", "1995"], "weekday": ["Monday"]}, "year_key IN ('1994', '1995') AND day_key = 'Monday'"),
    "season": ({"season": ["winter"]}, "substr(month_key, 6, 2) IN ('12', '01', '02')"),
    "month_of_year": ({"month_of_year": [3, 11]}, "substr(month_key, 6, 2) IN ('03', '11')"),
    "date_range": ({"dates": ("1995-02-01", "1996-03-31")}, "date_key BETWEEN '1995-02-01' AND '1996-03-31'"),
    "person_count": ({"people": ["0", "3+"]}, "person_count = 0 OR person_count >= 3"),
    "status_incomplete": ({"analysed": False}, "analysis_status_primary IS NULL OR analysis_status_primary NOT IN ('success', 'failed')"),
    "status_complete": ({"analysed": True, "faces": True}, "analysis_status_primary IN ('success', 'failed') AND face_count > 0"),
    "resolution_sd": ({"resolution": ["sd"]}, "NOT (greatest(width_px, height_px) >= 1920 AND least(width_px, height_px) >= 1080)"),
    "resolution_4k": ({"resolution": ["uhd4k", "fhd"]}, "greatest(width_px, height_px) >= 1920 AND least(width_px, height_px) >= 1080 AND NOT (greatest(width_px, height_px) >= 7680 AND least(width_px, height_px) >= 4320)"),
    "duration": ({"duration": ["<=15", ">1200"]}, "duration_sec <= 15 OR duration_sec > 1200"),
    "since": ({"since": "1997-01-01", "favorite": True}, "created_at >= TIMESTAMP '1997-01-01' AND is_favorite = 1"),
}
for _k, (_f, _sql) in _FILTERS.items():
    _add(f"filter_{_k}", lambda s, d, f=_f: _live(s, d).where(filters.compiled(f)).select("id", "user_id"), _LIVE + f"SELECT id, user_id FROM live WHERE {_sql}")

_VIEWS = duck("media", "album_media", "albums", "faces") + ", live AS (SELECT * FROM media WHERE deleted_at IS NULL)\n"
_add("scope_album", lambda s, d: filters.within(_live(s, d), view(s, d, "album_media").where("album_id = 7")).select("id"), _VIEWS + "SELECT id FROM live WHERE id IN (SELECT media_id FROM album_media WHERE album_id = 7)")
_add("scope_person", lambda s, d: filters.within(_live(s, d), view(s, d, "faces").where("user_id = 2 AND cluster_id = 3")).select("id"), _VIEWS + "SELECT id FROM live WHERE id IN (SELECT media_id FROM faces WHERE user_id = 2 AND cluster_id = 3)")
_add("filter_age_group", lambda s, d: filters.of_age(_live(s, d), view(s, d, "faces"), [(0, 2), (13, 19)]).select("id"), _VIEWS + "SELECT id FROM live m WHERE EXISTS (SELECT 1 FROM faces f WHERE f.media_id = m.id AND (age BETWEEN 0 AND 2 OR age BETWEEN 13 AND 19))")
_add("faces_unassigned_anti", lambda s, d: (f := view(s, d, "faces")).join(f.where("is_user_assigned").select("face_id"), "face_id", "left_anti").select("face_id", "user_id"), _VIEWS + "SELECT face_id, user_id FROM faces f WHERE NOT EXISTS (SELECT 1 FROM faces g WHERE g.face_id = f.face_id AND g.is_user_assigned)")
_add("album_stats", lambda s, d: rollups.album_stats(view(s, d, "album_media"), _live(s, d)).select("album_id", "media_count", "cover_media_id", F.col("first_at").cast("string").alias("first_at"), F.col("last_at").cast("string").alias("last_at")),
     _VIEWS + "SELECT album_id, count(*) AS media_count, max({'a': added_at, 'm': media_id}).m AS cover_media_id, CAST(min(captured_at) AS VARCHAR) AS first_at, CAST(max(captured_at) AS VARCHAR) AS last_at FROM album_media a JOIN live m ON a.media_id = m.id GROUP BY album_id")
_add("recent_albums", lambda s, d: filters.page(view(s, d, "albums"), [F.coalesce("last_used_at", "created_at").desc(), F.col("id")], 1, 8).select("id", "name"), _VIEWS + "SELECT id, name FROM albums ORDER BY coalesce(last_used_at, created_at) DESC, id LIMIT 8")
_add("albums_displayable", lambda s, d: rollups.displayable(view(s, d, "album_media"), _live(s, d), 2), _VIEWS + "SELECT album_id, count(*) AS n FROM album_media a JOIN live m ON a.media_id = m.id GROUP BY album_id HAVING count(*) >= 2")
_CARDS = "SELECT user_id, cluster_id, max(nullif(trim(name), '')) AS name, count(DISTINCT media_id) AS media_count, min({'r': -representative_type, 'f': face_id}).f AS cover_face_id FROM (SELECT f.* FROM faces f JOIN live m ON f.media_id = m.id) GROUP BY user_id, cluster_id"
_add("person_cards", lambda s, d: rollups.person_cards(view(s, d, "faces"), _live(s, d)).select("user_id", "cluster_id", "name", "media_count", "cover_face_id"), _VIEWS + _CARDS)
_add("person_recent", lambda s, d: rollups.person_cards(view(s, d, "faces"), _live(s, d)).orderBy(F.col("name").isNotNull().desc(), F.col("media_count").desc(), "user_id", "cluster_id").limit(20).select("user_id", "cluster_id", "media_count"),
     _VIEWS + f"SELECT user_id, cluster_id, media_count FROM ({_CARDS}) ORDER BY name IS NOT NULL DESC, media_count DESC, user_id, cluster_id LIMIT 20")
_add("person_stats", lambda s, d: view(s, d, "faces").groupBy("user_id").agg(F.count_distinct("cluster_id").alias("clusters"), F.count("*").alias("faces"), F.max("cluster_id").alias("last_cluster")), _VIEWS + "SELECT user_id, count(DISTINCT cluster_id) AS clusters, count(*) AS faces, max(cluster_id) AS last_cluster FROM faces GROUP BY user_id")
_add("failure_counts", lambda s, d: _live(s, d).groupBy("user_id").agg(F.count_if(F.col("analysis_status_primary") == "failed").alias("failed"), F.count_if(F.col("analysis_status_primary").isNull()).alias("pending")), _VIEWS + "SELECT user_id, count(*) FILTER (analysis_status_primary = 'failed') AS failed, count(*) FILTER (analysis_status_primary IS NULL) AS pending FROM live GROUP BY user_id")
_add("export_names", lambda s, d: rollups.numbered_names(_live(s, d).select("id", F.coalesce(media.place(), F.lit("unknown")).alias("name"))), _LIVE + "SELECT id, name, CASE WHEN k = 1 THEN name ELSE name || '_' || (k - 1) END AS unique_name FROM (SELECT id, coalesce(place, 'unknown') AS name, row_number() OVER (PARTITION BY coalesce(place, 'unknown') ORDER BY id) AS k FROM live)")
_add("cleanup_rank_score", lambda s, d: _live(s, d).select("id", media.cleanup_score().alias("score")),
     _LIVE + f"SELECT id, CAST(is_favorite * 1e13 + round(least(greatest(sharpness_score, 0), 1) * 1000) * 1e9 + round(least(ln(1 + width_px * height_px) / ln(1 + 40000000), 1) * 1000) * 1e6 + CAST({_HAPPY.format('happy')} AS INT) * 1e5 + least(face_count, 99) * 1e3 + least(person_count, 99) AS DOUBLE) AS score FROM live")
_add("blur_flags", lambda s, d: _live(s, d).where("sharpness_score < 0.25").select("id", "sharpness_score"), _LIVE + "SELECT id, sharpness_score FROM live WHERE sharpness_score < 0.25")
_add("blurry_page", lambda s, d: filters.page(_live(s, d).where("sharpness_score < 0.25"), [F.col("sharpness_score"), F.col("id")], 1, 200).select("id", "sharpness_score"), _LIVE + "SELECT id, sharpness_score FROM live WHERE sharpness_score < 0.25 ORDER BY sharpness_score, id LIMIT 200")
_add("orientation_class", lambda s, d: _live(s, d).select("id", *(c.alias(n) for c, n in zip(media.oriented(), ("aspect", "layout"), strict=True))),
     _LIVE + "SELECT id, aspect, CASE WHEN aspect > 2.5 THEN 'panorama' WHEN aspect > 1.2 THEN 'landscape' WHEN aspect < 0.8 THEN 'portrait' ELSE 'square' END AS layout FROM (SELECT id, round(CASE WHEN raw_orientation BETWEEN 5 AND 8 THEN height_px / width_px ELSE width_px / height_px END, 3) AS aspect FROM live)")

# ---- search over documents
_FIELDS = {"description": "text", "keywords": "source", "scene_tags": "lang"}
_WANTED = ["the", "src3", "en", "that"]


def _docs(s: SparkSession, d: str) -> DataFrame:
    return base(s, d, "documents").withColumnRenamed("doc_id", "media_id")


_INDEX = """WITH t AS (SELECT doc_id AS media_id, 'description' AS field, text AS c FROM documents UNION ALL SELECT doc_id, 'keywords', source FROM documents UNION ALL SELECT doc_id, 'scene_tags', lang FROM documents),
i AS (SELECT DISTINCT media_id, field, unnest(list_concat(regexp_extract_all(lower(c), '[a-z]{2,}'), regexp_extract_all(c, '[0-9]+'))) AS term FROM t)
"""
_RECALL = "SELECT media_id, CAST(sum(CASE field WHEN 'description' THEN 200 WHEN 'keywords' THEN 180 ELSE 100 END + CASE WHEN length(term) >= 2 THEN 40 ELSE 16 END) AS BIGINT) AS score, count(DISTINCT term) AS hits FROM i WHERE term IN ('the', 'src3', 'en', 'that') GROUP BY media_id"
_add("term_index", lambda s, d: search.term_index(_docs(s, d), _FIELDS).groupBy("field", "term").agg(F.count("*").alias("n")), _INDEX + "SELECT field, term, count(*) AS n FROM i GROUP BY field, term")
_add("term_recall", lambda s, d: search.term_recall(search.term_index(_docs(s, d), _FIELDS, _WANTED), _WANTED), _INDEX + _RECALL)
_add("term_and", lambda s, d: search.term_recall(search.term_index(_docs(s, d), _FIELDS, _WANTED), _WANTED).where("hits = 3").select("media_id"), _INDEX + f"SELECT media_id FROM ({_RECALL}) WHERE hits = 3")
_add("ocr_substring_recall", lambda s, d: _docs(s, d).where(F.lower("text").contains("thein")).select("media_id", F.lit(search.OCR_HIT).alias("score")), "SELECT doc_id AS media_id, 85 AS score FROM documents WHERE contains(lower(text), 'thein')")
_BM25 = r"""t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS a, regexp_extract_all(lower(source), '[\p{L}\p{N}]+') AS b FROM documents),
r AS (SELECT doc_id, len(a) + len(b) AS d, 6.0 * len(list_filter(a, lambda x: x = 'then')) + 3.0 * len(list_filter(b, lambda x: x = 'then')) AS f0, 6.0 * len(list_filter(a, lambda x: x = 'ingen')) + 3.0 * len(list_filter(b, lambda x: x = 'ingen')) AS f1 FROM t),
s AS (SELECT count(*) AS n, avg(d) AS ad, count(*) FILTER (f0 > 0) AS n0, count(*) FILTER (f1 > 0) AS n1 FROM r),
m AS (SELECT doc_id AS media_id, CASE WHEN ln((n - n0 + 0.5) / (n0 + 0.5)) > 0 THEN ln((n - n0 + 0.5) / (n0 + 0.5)) ELSE 1e-6 END * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * d / ad)) + CASE WHEN ln((n - n1 + 0.5) / (n1 + 0.5)) > 0 THEN ln((n - n1 + 0.5) / (n1 + 0.5)) ELSE 1e-6 END * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * d / ad)) AS score FROM r, s WHERE f0 > 0 AND f1 > 0)
"""
_bm25 = lambda s, d: search.bm25(_docs(s, d), {"text": 6, "source": 3}, ["then", "ingen"])
_add("bm25_recall", lambda s, d: _bm25(s, d).select("media_id", F.round("score", 6).alias("score")), f"WITH {_BM25} SELECT media_id, round(score, 6) AS score FROM m")
_add("fts_position_scores", lambda s, d: search.position_scores(_bm25(s, d)), f"WITH {_BM25} SELECT media_id, CAST(greatest(6, 29 - row_number() OVER (ORDER BY round(score, 9) DESC, media_id)) AS INT) AS score FROM m")
_QUERY = [1.0 / 8] * 64
_SIM = "list_dot_product(CAST(embedding AS DOUBLE[]), list_transform(range(64), lambda x: 0.125::DOUBLE))"
_vectors = lambda s, d: base(s, d, "embeddings").withColumnRenamed("vec_id", "id")
_add("vector_recall_topk", lambda s, d: neighbours.most_alike(_vectors(s, d), _QUERY, 0.05, 25).select("id", F.round("similarity", 6).alias("similarity")), f"SELECT vec_id AS id, round({_SIM}, 6) AS similarity FROM embeddings WHERE {_SIM} >= 0.05 ORDER BY round({_SIM}, 9) DESC, vec_id DESC LIMIT 25")


def _hybrid(s: SparkSession, d: str) -> DataFrame:
    alike = neighbours.most_alike(_vectors(s, d), _QUERY, 0.05, 25).select(F.col("id").alias("media_id"), (F.col("similarity") * search.VECTOR).alias("score"))
    ocr = QUERIES["ocr_substring_recall"](s, d)
    out = search.fused({"terms": QUERIES["term_recall"](s, d), "ocr": ocr, "vector": alike})
    return out.orderBy(F.col("tier").desc(), F.col("score").desc(), F.col("media_id").desc()).limit(50).select("media_id", F.round("score", 3).alias("score"), "tier")


_add("hybrid_search", _hybrid,
     _INDEX + f""", v AS (SELECT vec_id, {_SIM} AS sim FROM embeddings), u AS (SELECT media_id, CAST(score AS DOUBLE) AS score, 0 AS o, 0 AS w FROM ({_RECALL}) UNION ALL SELECT doc_id, 85, 1, 0 FROM documents WHERE contains(lower(text), 'thein')
UNION ALL SELECT * FROM (SELECT vec_id, sim * 120, 0, 1 FROM v WHERE sim >= 0.05 ORDER BY round(sim, 9) DESC, vec_id DESC LIMIT 25)),
g AS (SELECT media_id, round(sum(score), 6) AS score, CASE WHEN max(o) = 1 AND max(w) = 1 THEN 3 WHEN max(o) = 1 THEN 2 WHEN max(w) = 1 THEN 1 ELSE 0 END AS tier FROM u GROUP BY media_id)
SELECT media_id, round(score, 3) AS score, tier FROM g ORDER BY tier DESC, g.score DESC, media_id DESC LIMIT 50""")  # fmt: skip

# ---- vectors, hashes, faces
_add("vector_centroid", lambda s, d: neighbours.centroids(view(s, d, "faces")).select("user_id", "cluster_id", "place", F.round("mean", 6).alias("mean")), _VIEWS + ", e AS (SELECT user_id, cluster_id, unnest(range(64)) AS place, unnest(embedding) AS v FROM faces) SELECT user_id, cluster_id, CAST(place AS INT) AS place, round(avg(CAST(v AS DOUBLE)), 6) AS mean FROM e GROUP BY user_id, cluster_id, place")
_hashes = lambda s, d: view(s, d, "faces").select("user_id", F.col("face_id").alias("id"), vectors.sign_bits(F.col("embedding")).alias("h"))
_add("hamming_pairs", lambda s, d: neighbours.hamming_pairs(_hashes(s, d), 18), _VIEWS + "SELECT f.user_id, f.face_id AS a, g.face_id AS b, CAST(len(list_filter(range(1, 65), lambda i: (f.embedding[i] > 0) <> (g.embedding[i] > 0))) AS INT) AS d FROM faces f JOIN faces g ON f.user_id = g.user_id AND f.face_id < g.face_id WHERE len(list_filter(range(1, 65), lambda i: (f.embedding[i] > 0) <> (g.embedding[i] > 0))) <= 18")
_add("hamming_groups", lambda s, d: neighbours.star_groups(neighbours.hamming_pairs(_hashes(s, d), 20)))
_add("cluster_min_distance", lambda s, d: neighbours.cluster_distances(view(s, d, "faces")).select("user_id", "a", "b", F.round("distance", 6).alias("distance")), _VIEWS + "SELECT f.user_id, f.cluster_id AS a, g.cluster_id AS b, round(min(1 - list_dot_product(CAST(f.embedding AS DOUBLE[]), CAST(g.embedding AS DOUBLE[]))), 6) AS distance FROM faces f JOIN faces g ON f.user_id = g.user_id AND f.cluster_id < g.cluster_id GROUP BY 1, 2, 3")
_add("cluster_overlap_iou", lambda s, d: neighbours.overlaps((f := view(s, d, "faces")).select("cluster_id", "face_id"), f.where("face_id % 3 > 0").select((F.col("cluster_id") + F.col("face_id") % 2).alias("cluster_id"), "face_id")).select("old", "new", "common", F.round("iou", 6).alias("iou")),
     _VIEWS + ", n AS (SELECT cluster_id + face_id % 2 AS c, face_id FROM faces WHERE face_id % 3 > 0), k AS (SELECT f.cluster_id AS old, n.c AS new, count(*) AS common FROM faces f JOIN n USING (face_id) GROUP BY 1, 2) SELECT old, new, common, round(common / ((SELECT count(*) FROM faces WHERE cluster_id = old) + (SELECT count(*) FROM n WHERE c = new) - common), 6) AS iou FROM k")


# ---- geography: made-up places of suppliers
def _points(s: SparkSession, d: str) -> DataFrame:
    return base(s, d, "supplier").select("s_suppkey", (F.lit(70.0) + F.col("s_suppkey") * 13 % 700 / 10).alias("lng"), (F.lit(0.0) + F.col("s_suppkey") * 29 % 580 / 10).alias("lat"))


def _offset_sql(spec: tuple, axis: str) -> str:
    (c, cx, cy, c2, cxy, root), waves = spec
    return f"({c} + {cx} * x + {cy} * y + {c2} * {axis} * {axis} + {cxy} * x * y + {root} * sqrt(abs(x)) + (" + " + ".join(f"{a} * sin({v} * {math.pi / k!r})" for a, k, v in waves) + ") * 2 / 3)"


_POINTS = "WITH p AS (SELECT s_suppkey, 70.0::DOUBLE + s_suppkey * 13 % 700 / 10 AS lng, s_suppkey * 29 % 580 / 10 AS lat FROM supplier)"
_add("wgs_to_gcj", lambda s, d: _points(s, d).select("s_suppkey", *(F.round(c, 6).alias(n) for c, n in zip(geo.wgs_to_gcj(F.col("lng"), F.col("lat")), ("lng", "lat"), strict=True))),
     _POINTS + f""", q AS (SELECT *, lng - 105 AS x, lat - 35 AS y, radians(lat) AS rad, 1 - {geo.ECCENTRICITY_2!r} * sin(radians(lat)) * sin(radians(lat)) AS m, lng BETWEEN 72.004 AND 137.8347 AND lat BETWEEN 0.8293 AND 55.8271 AS inside FROM p)
SELECT s_suppkey, round(lng + CASE WHEN inside THEN {_offset_sql(geo.LNG, 'x')} * 180 / ({geo.SEMI_MAJOR} / sqrt(m) * cos(rad) * pi()) ELSE 0 END, 6) AS lng,
round(lat + CASE WHEN inside THEN {_offset_sql(geo.LAT, 'y')} * 180 / ({geo.SEMI_MAJOR} * (1 - {geo.ECCENTRICITY_2!r}) / (m * sqrt(m)) * pi()) ELSE 0 END, 6) AS lat FROM q""")  # fmt: skip
_add("point_in_smallest_box", lambda s, d: _smallest_box(_points(s, d), base(s, d, "nation")), _POINTS + ", b AS (SELECT n_nationkey, 72.0 + n_nationkey * 2.5 AS w, n_nationkey * 1.5 AS s, 4.0 + n_nationkey % 7 AS size FROM nation) SELECT s_suppkey, min({'a': size, 'k': n_nationkey}).k AS n_nationkey FROM p JOIN b ON lng BETWEEN w AND w + size AND lat BETWEEN s AND s + size * 3 GROUP BY s_suppkey")


def _smallest_box(points: DataFrame, nation: DataFrame) -> DataFrame:
    """The smallest box around each point. Boxes and points meet in cells of 8 degrees, so the join is by equality."""
    boxes = nation.select("n_nationkey", (72.0 + F.col("n_nationkey") * 2.5).alias("w"), (F.col("n_nationkey") * 1.5).alias("s"), (4.0 + F.col("n_nationkey") % 7).alias("size"))
    cell = lambda c: F.floor(c / 8)
    spread = lambda a, b: F.explode(F.sequence(cell(a), cell(b)))
    boxes = boxes.withColumn("cx", spread(F.col("w"), F.col("w") + F.col("size"))).withColumn("cy", spread(F.col("s"), F.col("s") + F.col("size") * 3))
    met = points.withColumn("cx", cell(F.col("lng"))).withColumn("cy", cell(F.col("lat"))).join(boxes, ["cx", "cy"])
    inside = F.col("lng").between(F.col("w"), F.col("w") + F.col("size")) & F.col("lat").between(F.col("s"), F.col("s") + F.col("size") * 3)
    return met.where(inside).groupBy("s_suppkey").agg(F.min(F.struct("size", "n_nationkey"))["n_nationkey"].alias("n_nationkey"))


# ---- table changes
def _new(s: SparkSession, d: str) -> DataFrame:
    return base(s, d, "orders").where("o_orderkey % 10 < 2").select((F.col("o_orderkey") + F.col("o_orderkey") % 2 * 1_000_000).alias("id"), F.lit("new").alias("status"))


def _old(s: SparkSession, d: str) -> DataFrame:
    return base(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))


_DML = "WITH old AS (SELECT o_orderkey AS id, o_orderstatus AS status FROM orders), new AS (SELECT o_orderkey + o_orderkey % 2 * 1000000 AS id, 'new' AS status FROM orders WHERE o_orderkey % 10 < 2) "
_add("merge_insert_ignore", lambda s, d: tables.insert_ignore(_old(s, d), _new(s, d), ["id"]), _DML + "SELECT * FROM old UNION ALL SELECT * FROM new WHERE id NOT IN (SELECT id FROM old)")
_add("merge_upsert", lambda s, d: tables.upsert(_old(s, d), _new(s, d), ["id"]), _DML + "SELECT * FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new")
_add("merge_patch", lambda s, d: tables.patch(_old(s, d), _new(s, d), ["id"], ["status"]), _DML + "SELECT id, coalesce(n.status, o.status) AS status FROM old o LEFT JOIN new n USING (id)")
_add("soft_delete", lambda s, d: live(tables.soft_delete(view(s, d, "media"), view(s, d, "media").where("id % 19 = 0"), 5)).select("id"), _LIVE + "SELECT id FROM live WHERE id % 19 <> 0")
_add("purge_edges", lambda s, d: tables.delete(view(s, d, "album_media"), view(s, d, "media").where("deleted_at IS NOT NULL"), "media_id").select("album_id", "media_id"), _VIEWS + "SELECT album_id, media_id FROM album_media WHERE media_id NOT IN (SELECT id FROM media WHERE deleted_at IS NOT NULL)")

# ---- ingest
_events = lambda s, d: base(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session_id"), "event_type")
_add("dedupe_first_seen", lambda s, d: ingest.once(_events(s, d), ["session_id", "event_type"], "ts").select("session_id", "event_type", F.unix_micros("ts").alias("first_us")), "SELECT user_id AS session_id, event_type, epoch_us(min(ts)) AS first_us FROM events GROUP BY 1, 2")
_add("session_debounce", lambda s, d: ingest.debounced(_events(s, d), "session_id", "ts", "6 hours").select("session_id", F.unix_micros("started").alias("started_us"), F.unix_micros("due").alias("due_us"), "jobs"),
     "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id AS session_id, epoch_us(min(ts)) AS started_us, epoch_us(max(ts) + INTERVAL 6 HOUR) AS due_us, count(*) AS jobs FROM k GROUP BY user_id, n")
_add("upload_progress", lambda s, d: ingest.progress(_events(s, d)),
     "WITH c AS (SELECT user_id AS session_id, count(*) FILTER (event_type = 'signup') AS uploaded, count(*) FILTER (event_type = 'view') AS ingest_done, count(*) FILTER (event_type = 'error') AS ingest_error, count(*) FILTER (event_type = 'click') AS ai_eligible, count(*) FILTER (event_type = 'purchase') AS ai_done FROM events GROUP BY 1) SELECT *, CASE WHEN uploaded = 0 THEN 'uploading' WHEN ingest_done + ingest_error < uploaded THEN 'mediaProcessing' WHEN ai_done < ai_eligible THEN 'aiAnalyzing' ELSE 'completed' END AS phase FROM c")
