"""Queries against their SQL on tables where rounding and chance meet them, and steps whose work must grow with the rows."""

import datetime
import random

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from shutterlake.functions.batches import utf8
from shutterlake.operators import intents, postings, segments
from shutterlake.plans.catalog import QUERIES, SQL
from shutterlake.sources.shared import many
from shutterlake.streaming import state


def agrees(spark, name, folder, tables):
    own = duckdb.connect()
    for t in tables:
        own.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    plain = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    want = own.sql(SQL[name])
    got = QUERIES[name](spark, folder).select(*want.columns)
    assert plain(map(tuple, got.collect())) == plain(want.fetchall())


def test_points_right_on_the_edges_of_areas(spark):
    # supplier 230 is on an edge of area 104; the points of all suppliers repeat after 700
    agrees(spark, "areas_of_points", "/root/testdata/sf0.1", ["supplier", "nation"])


def test_hashes_that_are_near_by_chance(spark, tmp_path):
    # blocks of 40 hashes; these two differ in 7 bits, so some rows of one are near some of the other
    own = duckdb.connect()
    for t in ("customer", "nation", "region"):
        own.sql(f"COPY (FROM '/root/testdata/sf0.001/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
    own.sql(f"""COPY (SELECT * EXCLUDE (k) REPLACE (CASE WHEN k < 40 THEN 6438 * 40 + k ELSE 9346 * 40 + k - 40 END AS o_orderkey, 5 AS o_custkey)
        FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM '/root/testdata/sf0.001/orders.parquet') WHERE k < 80) TO '{tmp_path}/orders.parquet'""")
    agrees(spark, "near_duplicate_groups", str(tmp_path), ["customer", "nation", "region", "orders"])


def test_figures_are_looked_for_once(spark):
    asked = spark.createDataFrame([(1, "去年, 2024-05-06"), (2, None)], "id int, text string")
    names = spark.createDataFrame([], "label string, term string")
    out = intents.understood(asked, names, F.lit("2025-03-15").cast("date")).select("id", "time.kind")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # each pattern's matches stand twice in a signal's place
    assert plan.count("regexp_extract_all") <= 3 * len(intents.PATTERNS)
    assert sorted(map(tuple, out.collect())) == [(1, "absolute_date"), (2, None)]


def test_routes_of_a_table_need_no_state_for_each_key(spark):
    begin = datetime.datetime(2025, 1, 1)
    events = [(1, "a", i, begin + datetime.timedelta(minutes=10 * i), "upload") for i in range(9)] + [(None, None, 9, None, "upload"), (None, None, 10, begin, "upload"), (2, "b", 11, begin, "upload")]
    media = [(2, "b", 5), (3, "c", None)]
    out = state.deduplicated(spark.createDataFrame(events, "user_id bigint, hash string, event_id bigint, ts timestamp, kind string"), spark.createDataFrame(media, "user_id bigint, hash string, deleted_at bigint"))
    assert "TransformWithState" not in out._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # a key goes on from batch to batch
    got = {r["event_id"]: r["route"] for r in out.collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {0: "new", 6: "new", 10: "new", 11: "restore"} | {i: "duplicate" for i in (1, 2, 3, 4, 5, 7, 8, 9)}


def test_a_long_text_is_cut_in_pieces(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice(["sea", "dog", "去年", "z", "é", "eado"]) for _ in range(20_000))
    steps, real = [], np.argmax
    monkeypatch.setattr(np, "argmax", lambda *a, **k: steps.append(1) or real(*a, **k))
    data, offsets = utf8(pa.array(["", text, None, "doga"]))
    start, end, _ = segments.Graph(["sea", "dog", "eado", "去年"], [9, 9, 1, 2]).cut(data, offsets)
    assert start[0] == 0 and end[-1] == len(data) and (start[1:] == end[:-1]).all() and set(offsets.tolist()) <= {0, *end.tolist()}
    assert len(steps) < 2_000


def test_entries_of_an_index_are_gathered_before_they_are_dealt(spark):
    docs = spark.range(400).select(F.col("id").alias("media_id"), F.lit("Sea dog sea").alias("text"), F.lit("dog").alias("source"))
    for made in (postings.fulltext(docs, {"text": 2.0, "source": 1.0}), postings.termed(docs, {"description": "text", "keywords": "source"})):
        assert made[0].count() <= 3 * many(spark) and made[1].count() == 400


def test_rows_that_share_an_id_add_up(spark, tmp_path):
    docs = spark.createDataFrame([(1, "sea dog"), (1, "sea"), (2, "sea"), (9, "x")], "media_id int, text string").repartition(3)
    postings.build(*postings.fulltext(docs, {"text": 1.0}), str(tmp_path / "i"))
    got = spark.read.parquet(str(tmp_path / "i/postings")).where("token = 'sea'").collect()
    assert [[tuple(e) for e in r["entries"]] for r in got] == [[(1, 2.0, 2), (2, 1.0, 1)]] and [(r["n"], r["max_tf"], r["min_d"]) for r in got] == [(2, 2.0, 1)]
