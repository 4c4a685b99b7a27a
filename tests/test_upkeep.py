"""Files, kept rankings, replaced rows, archives and kept state against plain versions."""

import datetime
import functools
import hashlib
import io
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from shutterlake.functions import codec, formats
from shutterlake.operators import ranked, rollups
from shutterlake.plans import upkeep
from shutterlake.sources import archives, versions
from shutterlake.streaming import state

DATA = "/root/testdata/sf0.001"


# ---- rows replaced owner by owner
SCHEMA = "owner bigint, v string"


def test_replaced_rows_are_old_or_new(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "groups")
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    owners = lambda ids: spark.createDataFrame([(i,) for i in ids], "owner bigint")
    now = lambda: sorted(map(str, versions.current(spark, path, SCHEMA, "owner").collect()))
    assert now() == []
    versions.replace(path, frame([(1, "a"), (1, "b"), (2, "c"), (None, "n")]), owners([1, 2, None]), 0)
    before = now()
    assert len(before) == 4
    new, own = frame([(1, "x"), (9, "not of these owners")]), owners([1, 2])
    # the job ends after the rows, then after the owners, then not
    for left in (1, 2):
        writes = iter(range(left))
        real = type(new.write).parquet

        def stops(self, *a, writes=writes, real=real, **k):
            if next(writes, None) is None:
                raise RuntimeError("lost")
            return real(self, *a, **k)

        monkeypatch.setattr(type(new.write), "parquet", stops)
        with pytest.raises(RuntimeError):
            versions.replace(path, new, own, 1)
        monkeypatch.undo()
        assert now() == before
    for _ in range(2):  # a batch that runs twice changes nothing
        versions.replace(path, new, own, 1)
        assert now() == sorted(map(str, frame([(1, "x"), (None, "n")]).collect()))
    versions.compacted(spark, path, SCHEMA, "owner", 2)
    assert now() == sorted(map(str, frame([(1, "x"), (None, "n")]).collect()))


def test_a_stream_replaces_owners(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    rebuilt = lambda owners: owners.withColumn("v", F.concat(F.lit("new "), F.col("owner").cast("string")))
    versions.replace(path, spark.createDataFrame([(2, "old"), (3, "old")], SCHEMA), spark.createDataFrame([(2,), (3,)], "owner bigint"), -1)
    query = stream.writeStream.foreachBatch(versions.replacing(path, "owner", rebuilt)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, versions.current(spark, path, SCHEMA, "owner").collect())) == [(1, "new 1"), (2, "new 2"), (3, "old")]


# ---- archives
def test_archives_hold_the_rows(spark, tmp_path):
    archives.register(spark)
    rows = [(f"f{i}.txt", f"text {i}".encode() * 30) for i in range(40)] + [("empty", None), ("字.txt", b"x")]
    frame = spark.createDataFrame(rows, "name string, content binary").repartition(3)
    frame.write.format("archives").option("path", str(tmp_path / "a")).option("most_bytes", 2_000).mode("append").save()
    made = sorted((tmp_path / "a").iterdir())
    assert all(p.suffix == ".zip" for p in made) and len(made) > 3
    back = {}
    for p in made:
        with zipfile.ZipFile(io.BytesIO(p.read_bytes())) as z:
            assert sum(i.file_size for i in z.infolist()) < 2_000 + 300
            back |= {n: z.read(n) for n in z.namelist()}
    assert back == {n: c or b"" for n, c in rows}
    frame.limit(0).write.format("archives").option("path", str(tmp_path / "b")).mode("append").save()
    with pytest.raises(Exception, match="without a name"):
        spark.createDataFrame([("a", b"x"), (None, b"y")], "name string, content binary").coalesce(1).write.format("archives").option("path", str(tmp_path / "c")).mode("append").save()
    assert [p for p in (tmp_path / "c").iterdir()] == []


def test_names_keep_extensions_and_stay_distinct(spark):
    names = ["a.jpg", "a.jpg", "a.jpg", "a_1.jpg", "a", "a", ".rc", ".rc", "x.tar.gz", "x.tar.gz", None, None, "b_7", "b", "b", "", "a_1.jpg"]
    got = {r["id"]: r["unique_name"] for r in rollups.numbered_names(spark.createDataFrame(list(enumerate(names)), "id bigint, name string")).collect()}
    assert [got[i] for i in range(len(names))] == ["a.jpg", "a_2.jpg", "a_3.jpg", "a_1.jpg", "a", "a_1", ".rc", ".rc_1", "x.tar.gz", "x.tar_1.gz", None, None, "b_7", "b", "b_8", "", "a_1_1.jpg"]


# ---- vectors and bytes
def test_codec_round_trip(spark):
    rows = [(0, [1.5, -2.0, 0.1]), (1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), float("inf")])] + [(i, [float(i)] * (i % 5)) for i in range(5, 60)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "id int, embedding array<float>, embedding_ string")
    blobs = {r["id"]: r["embedding"] for r in codec.encoded(frame.repartition(2)).collect()}
    assert {i: b if b is None else bytes(b) for i, b in blobs.items()} == {i: None if v is None or None in v else struct.pack(f"<{len(v)}f", *v) for i, v in rows}
    back = {r["id"]: r["embedding"] for r in codec.decoded(codec.encoded(frame)).collect()}
    assert str(back) == str({i: None if v is None or None in v else [struct.unpack("<f", struct.pack("<f", x))[0] for x in v] for i, v in rows})
    odd = spark.createDataFrame([(1, b"123"), (2, b"1234"), (3, None), (4, b"")], "id int, embedding binary")
    assert {r["id"]: r["embedding"] and len(r["embedding"]) for r in codec.decoded(odd).collect()} == {1: None, 2: 1, 3: None, 4: []}
    assert codec.decoded(odd.limit(0)).count() == 0


def test_formats_by_bytes(spark, tmp_path):
    heads = {"jpeg": b"\xff\xd8\xff\xe0", "png": b"\x89PNG\r\n\x1a\n", "gif": b"GIF87a", "bmp": b"BM\x00\x00", "tiff": b"MM\x00*", "webp": b"RIFF\x01\x02\x03\x04WEBP", "svg": b"  <?xml version", "heic": b"\0\0\0\x18ftyphevc", "heif": b"\0\0\0\x18ftypmsf1", "avif": b"\0\0\0\x18ftypavis"}
    for name, head in heads.items():
        (tmp_path / f"{name}.bin").write_bytes(head)
    for name, content in {"short": b"\xff\xd8\xff", "cut": b"\x89PNG\r\n", "text": b"hello", "late": b" " * 100 + b"<svg", "odd": b"\x03\xc7\x37\x66\x70\x00", "empty": b"", "brand": b"\0\0\0\x18ftypxxxx"}.items():
        (tmp_path / f"none_{name}.bin").write_bytes(content)
    got = {r["path"].rsplit("/", 1)[1][:-4]: r for r in formats.files(spark, str(tmp_path)).collect()}
    assert {n: r["format"] for n, r in got.items()} == {n: None if n.startswith("none") else n for n in got} and len(got) == 16  # not the empty file
    assert all(r["hash"] == hashlib.sha256((tmp_path / f"{n}.bin").read_bytes()).hexdigest() for n, r in got.items())
    assert {r["size"] for r in formats.sizes(spark, str(tmp_path)).collect()} == {r["size"] for r in got.values()}
    null = spark.createDataFrame([(None,)], "c binary").select(formats.image_format(F.col("c")), formats.content_hash(F.col("c"))).first()
    assert tuple(null) == (None, None)


# ---- rankings and covers
def test_pages_of_a_ranking_with_vanished_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK", 10)
    rng = random.Random(4)
    rows = [(i, rng.randrange(20)) for i in range(237)]
    path = str(tmp_path / "r")
    ranked.keep(spark.createDataFrame(rows, "id bigint, score int").repartition(4), [F.desc("score"), F.col("id")], path)
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    gone = {i for i, _ in order[30:120]} | {i for i, _ in rows if i % 5 == 0}
    live = spark.createDataFrame([(i,) for i, _ in rows if i not in gone], "id bigint")
    for offset, size in ((0, 7), (25, 12), (230, 20), (300, 5), (0, 500)):
        want = [(k, i) for k, (i, _) in enumerate(order) if k >= offset and i not in gone][:size]
        assert [(r["place"], r["id"]) for r in ranked.page(spark, path, "id bigint, score int", live, offset, size).collect()] == want
    assert ranked.page(spark, path, "id bigint, score int", live.limit(0), 0, 5).count() == 0


def test_tolerant_covers(spark):
    """Where the tolerances make an order, the first of a plain sort; else what is left of faces that meet in turn."""
    rng = random.Random(6)
    step = lambda: rng.choice([0.1, 0.3, 0.5, 0.7])
    kind = "user_id bigint, cluster_id bigint, face_id bigint, media_type string, expression string, quality_score double, yaw double, pitch double, bbox array<double>, sharpness_score double, created_at bigint"
    rows = [(i % 2, i % 5, i, rng.choice(["image", "video", None]), rng.choice(["happy", "neutral", None]), step(), rng.choice([0.0, 45.0, None]), 0.0, rng.choice([[0.0, 0.0, 10.0, 10.0], [0.0, 0.0, 100.0, 100.0], None, [1.0]]), step(), i * 7 % 400) for i in range(400)]
    rows += [(7, 7, None, "image", "happy", 0.9, 0.0, 0.0, None, 0.9, 1), (8, 8, 1000, None, None, None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, kind)

    def metrics(r):
        pose = max(0.0, 1 - (abs(r[6] or 0) / 90 + abs(r[7] or 0) / 90) / 2)
        area = (r[8][2] - r[8][0]) * (r[8][3] - r[8][1]) if r[8] and len(r[8]) == 4 else 0.0
        return int(r[3] == "video"), {"happy": 2, "neutral": 1}.get(r[4], 0), r[5] or 0.0, pose, area, r[9] or 0.0, r[10] or 0

    def rule(a, b):
        a, b = metrics(a), metrics(b)
        if a[0] != b[0]:
            return a[0] - b[0]
        if a[1] != b[1]:
            return b[1] - a[1]
        for k, most in ((2, 0.05), (3, 0.05), (4, 1000), (5, 0.05)):
            if abs(a[k] - b[k]) > most:
                return 1 if b[k] > a[k] else -1
        return b[6] - a[6]

    for tile in (1 << 12, 16):
        got = {(r["user_id"], r["cluster_id"]): r["face_id"] for r in ranked.tolerant_covers(frame, tile).collect()}
        want = {}
        for u, c in {(r[0], r[1]) for r in rows if r[2] is not None}:
            own = sorted((r for r in rows if (r[0], r[1]) == (u, c)), key=lambda r: r[2])
            want[u, c] = sorted(own, key=functools.cmp_to_key(rule))[0][2]
        assert got == want
    # no order: 1 and 2 are alike, 2 and 3 too, 3 beats 1
    chain = spark.createDataFrame([(1, 1, i, "image", None, q, 0.0, 0.0, None, 0.0, t) for i, q, t in ((1, 0.5, 3), (2, 0.54, 2), (3, 0.58, 1))], kind)
    assert [r["face_id"] for r in ranked.tolerant_covers(chain).collect()] == [3]


# ---- kept state
def plain_routes(events, media, life):
    known = {}
    for user, key, gone in media:
        known[user, key] = "live" if known.get((user, key)) == "live" or gone is None else "trash"
    due, out = {}, {}
    for user, key, event, at, kind in sorted(events, key=lambda e: (e[3], e[2])):
        k = (user, key)
        if known.get(k) == "pending" and at >= due[k]:
            del known[k]
        if kind == "upload":
            out[event] = {None: "new", "trash": "restore"}.get(known.get(k), "duplicate")
            if k not in known:
                known[k], due[k] = "pending", at + datetime.timedelta(seconds=life)
            elif known[k] == "trash":
                known[k] = "live"
        elif kind == "stored" and known.get(k) == "pending":
            known[k] = "live"
        elif kind == "trashed" and known.get(k) == "live":
            known[k] = "trash"
        elif kind == "removed":
            known.pop(k, None)
    return out


EVENTS = "user_id bigint, hash string, event_id bigint, ts timestamp, kind string"
START = datetime.datetime(2025, 1, 1)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_routes_of_a_table(spark):
    events, media = upkeep.uploads(spark, DATA)
    rows, known = [tuple(r) for r in events.collect()], [tuple(r) for r in media.collect()]
    got = {r["event_id"]: r["route"] for r in state.deduplicated(events, media).collect()}
    assert got == plain_routes(rows, known, state.LIFE) and set(got.values()) == {"new", "duplicate", "restore"}


def test_routes_of_a_stream_over_restarts(spark, tmp_path, rocks):
    """Bootstrap from the table, expiry of pending uploads, removal and re-upload, with a restart between the files."""
    rng = random.Random(5)
    media = [(1, "a", None), (1, "b", 5), (2, "a", 5), (2, "a", None)]
    kinds = ["upload", "upload", "upload", "stored", "trashed", "removed"]
    events = [(rng.randrange(1, 3), rng.choice("abc"), i, START + datetime.timedelta(minutes=7 * i), rng.choice(kinds)) for i in range(120)]
    known = spark.createDataFrame(media, "user_id bigint, hash string, deleted_at bigint")
    source, out = tmp_path / "in", str(tmp_path / "out")
    for k in range(3):
        spark.createDataFrame(events[40 * k : 40 * k + 40], EVENTS).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(EVENTS).parquet(str(source))
        query = state.deduplicated(stream, known).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = {r["event_id"]: r["route"] for r in spark.read.parquet(out).collect()}
    want = plain_routes(events, media, state.LIFE)
    assert got == want and {"new", "duplicate", "restore"} <= set(got.values())


def test_sessions_of_stream_and_table_agree(spark, tmp_path, rocks):
    rng = random.Random(7)
    rows = [(rng.randrange(3), i, START + datetime.timedelta(hours=rng.random() * 240), rng.random() < 0.15) for i in range(200)]
    rows.sort(key=lambda r: r[2])
    kind = "user_id bigint, event_id bigint, ts timestamp, begins boolean"
    want = []
    for user in range(3):
        own, open_ = [r for r in rows if r[0] == user], None
        for r in [*own, None]:
            if open_ and (r is None or r[2] >= open_[1] + datetime.timedelta(days=1) or r[3]):
                end = open_[1] + datetime.timedelta(days=1)
                want.append((user, open_[0], open_[1], *((r[2], open_[2], "replaced") if r and r[3] and r[2] < end else (end, open_[2], "expired"))))
                open_ = None
            if r and r[3]:
                open_ = [r[1], r[2], 0]
            if r and open_:
                open_[2] += 1
    table = sorted(map(tuple, state.sessions(spark.createDataFrame(rows, kind)).collect()))
    assert table == sorted(want)
    source, out = tmp_path / "in", str(tmp_path / "out")
    far = (9, 999, START + datetime.timedelta(days=30), False)  # moves the watermark beyond all lives
    for k in range(3):
        part = rows[70 * k : 70 * k + 70] + ([far] if k == 2 else [])
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(kind).parquet(str(source))
        query = state.sessions(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == table
