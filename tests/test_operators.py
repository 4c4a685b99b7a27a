"""Cases that the test tables don't have."""

import gzip
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from shutterlake.functions import geo, vectors
from shutterlake.operators import density, neighbours, people, places, search, tables
from shutterlake.sources import geojson, metadata
from shutterlake.streaming import ingest


def one(df):
    return df.first()[0]


def test_terms(spark):
    df = spark.createDataFrame([("小狗在 A cat 2024x",)], "t string")
    assert one(df.select(search.terms(F.col("t")))) == ["小", "狗", "在", "小狗", "狗在", "cat", "2024"]


def test_hamming_of_hex(spark):
    df = spark.createDataFrame([("f" * 16, "f" * 15 + "0"), ("f" * 16, "zz")], "a string, b string")
    got = df.select(vectors.hamming(vectors.hex_bits(F.col("a")), vectors.hex_bits(F.col("b")))).collect()
    assert [r[0] for r in got] == [4, 64]


def test_star_groups_are_not_transitive(spark):
    pairs = spark.createDataFrame([(1, 10, 20, 8), (1, 20, 30, 8)], "user_id bigint, a bigint, b bigint, d int")
    got = {(r["seed"], r["id"]) for r in neighbours.star_groups(pairs).collect()}
    assert got == {(10, 10), (10, 20)}


def test_outside_china_stays(spark):
    df = spark.createDataFrame([(2.35, 48.85)], "lng double, lat double")
    assert tuple(df.select(*geo.wgs_to_gcj(F.col("lng"), F.col("lat"))).first()) == (2.35, 48.85)


def test_there_and_back(spark):
    df = spark.createDataFrame([(116.4, 39.9)], "lng double, lat double")
    lng, lat = df.select(*geo.gcj_to_wgs(*geo.wgs_to_gcj(F.col("lng"), F.col("lat")))).first()
    assert abs(lng - 116.4) < 1e-4 and abs(lat - 39.9) < 1e-4


def test_patch_keeps_what_is_not_given(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id bigint, p string, q string")
    new = spark.createDataFrame([(1, None, "z")], "id bigint, p string, q string")
    assert sorted(map(tuple, tables.patch(old, new, ["id"], ["p", "q"]).collect())) == [(1, "a", "z"), (2, "b", "y")]


def test_stream_of_jobs_once(spark, tmp_path):
    rows = [("u", "h1", 0), ("u", "h1", 5), ("u", "h2", 9)]
    spark.createDataFrame(rows, "user string, hash string, s long").select("user", "hash", F.timestamp_seconds("s").alias("ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user string, hash string, ts timestamp").parquet(f"{tmp_path}/in")
    run = ingest.once(stream, ["user", "hash"], "ts").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {r["hash"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"h1", "h2"}
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_star_groups_against_the_greedy_walk(spark):
    rng = random.Random(5)
    links = sorted({(1 + k % 2, *sorted(rng.sample(range(60), 2))) for k in range(150)})
    want, used = set(), set()
    for user in (1, 2):
        for seed in range(60):
            members = [b for u, a, b in links if (u, a) == (user, seed) and (user, b) not in used]
            if (user, seed) not in used and members:
                used |= {(user, seed), *((user, x) for x in members)}
                want |= {(user, seed, x) for x in (seed, *members)}
    pairs = spark.createDataFrame(links, "user_id bigint, a bigint, b bigint")
    assert sorted(map(tuple, neighbours.star_groups(pairs).collect())) == sorted(want)
    assert neighbours.star_groups(pairs.limit(0)).count() == 0


@pytest.mark.parametrize("distance", [5, 8, 20])
def test_hamming_pairs_are_all_and_once(spark, distance, monkeypatch):
    monkeypatch.setattr(neighbours.tiles, "__defaults__", (16,))  # many tiles
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(8)]
    rows = [(k % 3, k, (base[k % 8] ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(12)))) - (1 << 63)) for k in range(120)]
    got = neighbours.hamming_pairs(spark.createDataFrame(rows, "user_id bigint, id bigint, h bigint"), distance).collect()
    want = [(u, a, b, n) for u, a, x in rows for v, b, y in rows if u == v and a < b and (n := ((x ^ y) & (1 << 64) - 1).bit_count()) <= distance]
    assert sorted(map(tuple, got)) == sorted(want)


def test_components_against_union_find(spark):
    rng = random.Random(8)
    links = [(u, *rng.sample(range(80), 2)) for u in (1, 2) for _ in range(50)] + [(3, k, k + 1) for k in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, a, b in links:
        x, y = sorted((find((u, a)), find((u, b))))
        root[y] = x
    got = neighbours.components(spark.createDataFrame(links, "user_id bigint, a bigint, b bigint"))
    assert sorted(map(tuple, got.collect())) == sorted((*x, find(x)[1]) for x in root)
    assert neighbours.components(got.selectExpr("user_id", "id AS a", "id AS b").limit(0)).count() == 0


def test_matched_is_the_greedy_choice(spark):
    rng = random.Random(9)
    pairs = sorted({(1, rng.randrange(25), rng.randrange(25)) for _ in range(120)})
    pairs = [(*p, rng.randrange(5) / 4) for p in pairs]
    want, old, new = [], set(), set()
    for u, a, b, iou in sorted(pairs, key=lambda p: (-p[3], p[1], p[2])):
        if a not in old and b not in new:
            want.append((u, a, b, iou))
            old.add(a)
            new.add(b)
    got = neighbours.matched(spark.createDataFrame(pairs, "user_id bigint, old bigint, new bigint, iou double"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_near_duplicates_against_the_walk(spark):
    rng = random.Random(10)
    centres = [rng.getrandbits(64) for _ in range(4)]
    rows = [(1, k, rng.choice(centres) ^ sum(1 << i for i in rng.sample(range(64), rng.choice([0, 0, 2, 4, 6])))) for k in range(90)]
    first = {}
    for _, k, h in rows:
        first.setdefault(h >> 32, k)
    order, used, want = sorted(rows, key=lambda r: (first[r[2] >> 32], r[1])), set(), set()
    for _, seed, h in order:
        if seed not in used:
            members = [(k, x) for _, k, x in order if k not in used and (x ^ h).bit_count() <= 8]
            used |= {k for k, _ in members}
            top = max(members)  # equal scores and times: the larger id
            want |= {(seed, k, math.floor((1 - (x ^ top[1]).bit_count() / 64) * 1e4 + 0.5) / 1e4, k == top[0]) for k, x in members if len(members) > 1}
    df = spark.createDataFrame([(u, k, f" {h:016X}", "2020-01-01") for u, k, h in rows] + [(1, 500, "zz", None), (1, 501, None, None)], "user_id bigint, id bigint, image_phash string, created_at string")
    got = neighbours.near_duplicates(df, F.lit(1.0)).select("group_id", "id", "similarity", "is_primary")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert neighbours.near_duplicates(df.limit(0), F.lit(1.0)).count() == 0


def test_geojson_and_areas(spark, tmp_path):
    box = lambda x, y, n: [[x, y], [x + n, y], [x + n, y + n], [x, y + n], [x, y]]
    feature = lambda k, name, kind, c: {"properties": {"adcode": k, "name": name, "parent": {"adcode": 1}}, "geometry": {"type": kind, "coordinates": c}}
    data = {"features": [feature(1, "p", "Polygon", [box(0, 0, 8), box(2, 2, 2)]), feature(2, "q", "MultiPolygon", [[box(20, 20, 1)], [box(30, -30, 2.5)]]), feature(3, "r", "Point", [1, 2])]}
    with gzip.open(tmp_path / "areas.json.gz", "wt") as f:
        json.dump(data, f)
    found = geojson.shapes(spark, f"{tmp_path}/areas.json.gz", "city")
    assert {(r["place_id"], r["parent_id"], len(r["rings"])) for r in found.collect()} == {(1, 1, 2), (2, 1, 2)}
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 3.0), (3, 20.5, 20.5), (4, 32.0, -29.0), (5, 25.0, 0.0), (6, None, 1.0)], "id bigint, lng double, lat double")
    got = {r["id"]: r["name"] for r in places.located(points, found).collect()}
    assert got == {1: "p", 2: None, 3: "q", 4: "q", 5: None, 6: None}


def test_metadata_bears_bad_json(spark):
    df = spark.createDataFrame([("",), ("{",), (None,), ('{"streams": []}',), ('{"Orientation": "?", "DateTimeOriginal": "x"}',)], "j string")
    assert {r["codec"] for r in df.select(*metadata.probed(F.col("j"))).collect()} == {None}
    assert {r["captured_ms"] for r in df.select(*metadata.exif(F.col("j"))).collect()} == {None}


def test_there_and_back_in_bd(spark):
    df = spark.createDataFrame([(116.4, 39.9)], "lng double, lat double")
    lng, lat = df.select(*geo.bd_to_wgs(*geo.wgs_to_bd(F.col("lng"), F.col("lat")))).first()
    assert abs(lng - 116.4) < 1e-4 and abs(lat - 39.9) < 1e-4


def test_length_units(spark):
    df = spark.createDataFrame([("小狗 cat 2024x",), (None,), ("  ",)], "t string")
    assert [r[0] for r in df.select(search.length_units(F.col("t"))).collect()] == [4, 0, 0]


def test_uploads_are_routed_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (1, None)], "user_id bigint, hash string").write.parquet(f"{tmp_path}/in")
    media = spark.createDataFrame([(7, 1, "a", None), (8, 1, "b", 5), (9, 1, "a", 5)], "id bigint, user_id bigint, hash string, deleted_at bigint")
    stream = spark.readStream.schema("user_id bigint, hash string").parquet(f"{tmp_path}/in")
    run = ingest.routed(stream, media).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {(r["hash"], r["route"], r["media_id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("a", "duplicate", 7), ("b", "restore", 8), ("c", "new", None), (None, "new", None)}


@pytest.mark.parametrize("block", [7, 2_048])
def test_density_clusters_against_the_walk(spark, block):
    rng = random.Random(5)
    rows = []
    for user in (1, 2):
        for k in range(60):
            turn = rng.choice([0.0, 0.3, 0.33, 1.5, 2.2, 4.0]) + rng.random() * 0.6
            rows.append((user, user * 1000 + k, [math.cos(turn), math.sin(turn)]))
    rows += [(3, 1, [1.0, 0.0]), (3, 2, None), (3, 1, [1.0, 0.0])]
    eps, least = 0.0005, 4
    want = set()
    for user in (1, 2):
        own = [(i, v) for u, i, v in rows if u == user]
        near = {i: [j for j, w in own if 1 - (v[0] * w[0] + v[1] * w[1]) <= eps] for i, v in own}
        label, n = {}, 0
        for i, _ in own:  # in order of id, as plain DBSCAN goes
            if i in label or len(near[i]) < least:
                continue
            queue, n = [i], n + 1
            while queue:
                x = queue.pop()
                if x in label:
                    continue
                label[x] = n - 1
                if len(near[x]) >= least:
                    queue += near[x]
        assert n > 1 and len(label) < len(own)
        want |= {(user, i, label.get(i, -1)) for i, _ in own}
    df = spark.createDataFrame(rows, "user_id bigint, face_id bigint, embedding array<double>")
    got = density.density_clusters(df, eps, least, block)
    assert {tuple(r) for r in got.collect()} == want | {(3, 1, -1)}
    assert density.density_clusters(df.limit(0), eps, least).count() == 0


def test_covers_by_rank_and_hand(spark):
    schema = "user_id bigint, cluster_id bigint, face_id bigint, representative_type int, media_type string, expression string, quality_score double, yaw double, pitch double, bbox array<double>, sharpness_score double, created_at bigint"
    row = lambda c, f, kind, media="image", look=None, q=0.5, box=None: (1, c, f, kind, media, look, q, None, None, box, None, None)
    rows = [row(1, 1, 0, "video", "happy", 1.0), row(1, 2, 0, q=0.51), row(1, 3, 0, q=0.53), row(1, 4, 2, "image", "happy"), row(2, 5, 2), row(2, 6, 2, look="neutral"), row(3, 7, 1), row(3, 8, 0, "image", "happy"), row(4, 9, 0, box=[1.0]), row(4, 10, 0, box=[0.0, 0.0, 50.0, 50.0])]
    faces = spark.createDataFrame(rows, schema)
    assert {(r.cluster_id, r.face_id) for r in people.default_covers(faces).collect()} == {(1, 2), (2, 6), (3, 8), (4, 10)}
    kinds = {r.face_id: r.representative_type for r in people.defaults_ensured(faces, faces).collect()}
    assert kinds == {1: 0, 2: 1, 3: 0, 4: 2, 5: 2, 6: 1, 7: 1, 8: 0, 9: 0, 10: 1}


def test_gate_without_words_or_text(spark):
    df = spark.createDataFrame([("A Dog runs",), (None,)], "t string")
    passes = lambda *a: [r[0] for r in df.select(search.passes_gate(F.col("t"), *a)).collect()]
    assert passes([]) == [False, False] and passes([[""]]) == [False, False]
    assert passes([["dog"], ["cat"]]) == [True, False]
    assert passes([["dog"], ["cat"], ["fish"]]) == [False, False]
    assert passes([["dog"], ["cat"]], ["CAT"]) == [False, False]
    assert [search.groups_needed(n) for n in range(7)] == [0, 1, 1, 2, 3, 3, 3]
