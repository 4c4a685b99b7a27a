"""Tables in the shape of a media library over the test tables: one text for Spark SQL and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TIME = {"year_key": ("yyyy", "%Y"), "month_key": ("yyyy-MM", "%Y-%m"), "date_key": ("yyyy-MM-dd", "%Y-%m-%d"), "day_key": ("EEEE", "%A")}
_KEYS = ",\n  ".join("CASE WHEN o.o_orderkey % 11 = 0 THEN 'unknown' ELSE <" + k + "> END AS " + k for k in _TIME)

VIEWS = {
    "media": f"""SELECT o.o_orderkey AS id, CAST(o.o_custkey % 5 AS BIGINT) AS user_id,
  CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE o.o_orderdate END AS captured_at, o.o_orderdate AS created_at,
  {_KEYS},
  CASE WHEN o.o_orderkey % 7 = 0 THEN NULL WHEN o.o_orderkey % 7 = 1 THEN ' ' ELSE n.n_name END AS city,
  CASE WHEN o.o_orderkey % 14 = 0 THEN NULL ELSE r.r_name END AS province, CAST(NULL AS <str>) AS country,
  CASE WHEN o.o_orderkey % 9 = 0 THEN 'video' ELSE 'image' END AS media_type,
  CASE WHEN o.o_orderkey % 17 = 0 THEN CAST(1 AS BIGINT) ELSE NULL END AS deleted_at,
  CAST(o.o_orderkey % 4 AS INT) AS face_count, CAST(o.o_orderkey % 5 AS INT) AS person_count,
  CASE WHEN o.o_orderkey % 3 = 0 THEN 'happy, sad' WHEN o.o_orderkey % 3 = 1 THEN 'neutral' ELSE NULL END AS expression_tags,
  CAST((o.o_orderkey * 37) % 101 AS DOUBLE) / 100 AS preferred_face_quality,
  CAST((o.o_orderkey * 53) % 103 AS DOUBLE) / 102 AS sharpness_score,
  CASE WHEN o.o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS is_favorite,
  CAST(600 + (o.o_orderkey * 131) % 7000 AS BIGINT) AS width_px, CAST(400 + (o.o_orderkey * 71) % 5000 AS BIGINT) AS height_px,
  CAST(1 + o.o_orderkey % 8 AS BIGINT) AS raw_orientation,
  CASE WHEN o.o_orderkey % 9 = 0 THEN CAST((o.o_orderkey * 7) % 1500 AS DOUBLE) ELSE NULL END AS duration_sec,
  CASE o.o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'success' ELSE NULL END AS analysis_status_primary
FROM <orders> o JOIN <customer> c ON o.o_custkey = c.c_custkey JOIN <nation> n ON c.c_nationkey = n.n_nationkey JOIN <region> r ON n.n_regionkey = r.r_regionkey""",
    "album_media": "SELECT CAST(l_suppkey AS BIGINT) AS album_id, l_orderkey AS media_id, MAX(l_shipdate) AS added_at FROM <lineitem> GROUP BY l_suppkey, l_orderkey",
    "albums": "SELECT s_suppkey AS id, s_suppkey % 5 AS user_id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey * 11 % 97 END AS last_used_at, s_suppkey % 89 AS created_at FROM <supplier>",
    "faces": """SELECT CAST(vec_id % 5 AS BIGINT) AS user_id, CAST(label AS BIGINT) AS cluster_id, vec_id AS face_id, vec_id % 211 AS media_id,
  CASE WHEN vec_id % 4 = 0 THEN NULL ELSE 'P' || CAST(label AS <str>) END AS name, CASE WHEN vec_id % 50 = 0 THEN 2 WHEN vec_id % 25 = 1 THEN 1 ELSE 0 END AS representative_type,
  CASE WHEN vec_id % 13 = 0 THEN NULL ELSE CAST(vec_id * 7 % 90 AS INT) END AS age, vec_id % 6 = 0 AS is_user_assigned, embedding FROM <embeddings>""",
}


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bases(sql: str) -> list[str]:
    return [t for t in ("orders", "customer", "nation", "region", "lineitem", "supplier", "embeddings") if f"<{t}>" in sql]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    for k, (java, _) in _TIME.items():
        sql = sql.replace(f"<{k}>", f"date_format(o.o_orderdate, '{java}')")
    sql, tables = sql.replace("<str>", "STRING"), _bases(sql)
    for t in tables:
        sql = sql.replace(f"<{t}>", "{" + t + "}")
    return spark.sql(sql, **{t: base(spark, sf_dir, t) for t in tables})


def live(media: DataFrame) -> DataFrame:
    """Without soft-deleted rows."""
    return media.where("deleted_at IS NULL")


def duck(*names: str) -> str:
    """The views as CTEs in DuckDB's SQL."""
    out = []
    for name in names:
        sql = VIEWS[name]
        for k, (_, c) in _TIME.items():
            sql = sql.replace(f"<{k}>", f"strftime(o.o_orderdate, '{c}')")
        sql = sql.replace("<str>", "VARCHAR")
        for t in _bases(sql):
            sql = sql.replace(f"<{t}>", t)
        out.append(f"{name} AS ({sql})")
    return "WITH " + ",\n".join(out)
