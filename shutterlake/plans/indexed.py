"""Searches of a kept index: written from an older state of the documents, changed to the present one, then read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.operators import postings, search
from shutterlake.plans.queries import _BM25, _FIELDS, _INDEX, _RECALL, _WANTED, Query, _docs
from shutterlake.sources.shared import folder

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_TERMS = ["then", "ingen"]


def _add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


def _index(s: SparkSession, d: str, make) -> str:
    """An index of a library where a third of the texts were others, a seventh was not there yet and some were there that are gone, brought
    up to date by the documents that changed."""
    docs, path = _docs(s, d), folder(s)
    text = F.when(F.col("media_id") % 3 == 0, F.concat(F.lit("then ingen that "), F.reverse("text"))).otherwise(F.col("text"))
    past = docs.where("media_id % 7 > 0").withColumn("text", text)
    gone = docs.where("media_id % 5 = 0").withColumn("media_id", F.col("media_id") + 1_000_000_000)
    postings.build(*make(past.unionByName(gone)), path)
    postings.change(*make(docs.where("media_id % 3 = 0 OR media_id % 7 = 0")), gone.select("media_id"), path)
    return path


def _full(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    return postings.fulltext(docs, {"text": 6, "source": 3})


def _termed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    return postings.termed(docs, _FIELDS)


_add("kept_bm25", lambda s, d: postings.bm25(s, _index(s, d, _full), _TERMS).select("media_id", F.round("score", 6).alias("score")), f"WITH {_BM25} SELECT media_id, round(score, 6) AS score FROM m")
_add("kept_bm25_top", lambda s, d: postings.bm25_top(s, _index(s, d, _full), _TERMS, 20).select("media_id", F.round("score", 6).alias("score")),
     f"WITH {_BM25} SELECT media_id, round(score, 6) AS score FROM m ORDER BY round(score, 9) DESC, media_id LIMIT 20")
_add("kept_position_scores", lambda s, d: search.position_scores(postings.bm25(s, _index(s, d, _full), _TERMS)),
     f"WITH {_BM25} SELECT media_id, CAST(greatest(6, 29 - row_number() OVER (ORDER BY round(score, 9) DESC, media_id)) AS INT) AS score FROM m")
_add("kept_term_recall", lambda s, d: postings.term_recall(s, _index(s, d, _termed), list(_FIELDS), _WANTED), _INDEX + _RECALL)


def _segments(s: SparkSession, d: str) -> DataFrame:
    """A search for each benchmark item: its first word, and one of the next two."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))
    terms = F.explode(F.array(*(F.struct(F.lit(min(k, 1)).alias("segment"), F.get(F.col("w"), F.lit(k)).alias("term")) for k in range(3))))
    queries = s.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), w.alias("w")).select("query_id", terms.alias("t")).select("query_id", "t.*").where("term IS NOT NULL")
    return postings.segment_recall(s, _index(s, d, _termed), list(_FIELDS), queries)


_add("kept_segment_recall", _segments, _INDEX + """, b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]{2,}') AS w FROM benchmark),
q AS (SELECT DISTINCT * FROM (SELECT item_id AS query_id, 0 AS segment, w[1] AS term FROM b UNION ALL SELECT item_id, 1, w[2] FROM b UNION ALL SELECT item_id, 1, w[3] FROM b) WHERE term IS NOT NULL),
n AS (SELECT query_id, count(DISTINCT segment) AS n FROM q GROUP BY query_id), h AS (SELECT query_id, segment, media_id, field, i.term FROM q JOIN i ON i.term = q.term),
k AS (SELECT h.query_id, media_id FROM h JOIN n ON n.query_id = h.query_id GROUP BY h.query_id, media_id HAVING count(DISTINCT segment) = any_value(n.n))
SELECT query_id, media_id, CAST(sum(CASE field WHEN 'description' THEN 200 WHEN 'keywords' THEN 180 ELSE 100 END + 40) AS BIGINT) AS score FROM (SELECT DISTINCT h.query_id, h.media_id, field, term FROM h JOIN k ON k.query_id = h.query_id AND k.media_id = h.media_id) GROUP BY query_id, media_id""")
