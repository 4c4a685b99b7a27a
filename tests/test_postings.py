"""The kept index against scoring of all texts, over changes, broken writes and hard rows."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from shutterlake.operators import postings, search

FIELDS = {"text": 2.0, "source": 1.0}


def rows(frame):
    return {r["media_id"]: round(r["score"], 9) for r in frame.collect()}


@pytest.fixture
def library(spark, monkeypatch):
    monkeypatch.setattr(postings, "SPAN", 8)
    rng = random.Random(3)
    words = ["sea", "dog", "sun", "去", "a1"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))
    return spark.createDataFrame([(i * 3, text(), rng.choice(words)) for i in range(80)] + [(500, None, None), (501, "", "")], "media_id bigint, text string, source string"), text


@pytest.mark.parametrize("wanted", [["dog", "dog", "去"], ["sea", "none"]])
def test_changes_give_the_index_of_the_new_texts(spark, tmp_path, library, wanted):
    docs, text = library
    path = str(tmp_path / "index")
    postings.build(*postings.fulltext(docs, FIELDS), path)
    assert rows(postings.bm25(spark, path, wanted)) == rows(search.bm25(docs, FIELDS, list(dict.fromkeys(wanted))))
    for step in range(2):
        new = spark.createDataFrame([(i * 3 + step, text(), "sun") for i in range(step, 90, 5)], docs.schema)
        gone = docs.where(F.col("media_id") % 9 == 3 * step).select("media_id")
        postings.change(*postings.fulltext(new, FIELDS), gone.unionByName(new.select("media_id").limit(1)), path)  # a new text wins over its deletion
        now = docs.join(new, "media_id", "left_anti").join(gone, "media_id", "left_anti").unionByName(new)
        docs = spark.createDataFrame(now.collect(), docs.schema)
        want = rows(search.bm25(docs, FIELDS, list(dict.fromkeys(wanted))))
        assert rows(postings.bm25(spark, path, wanted)) == want
        for k in (3, 500):
            best = sorted(want.items(), key=lambda x: (-x[1], x[0]))[:k]
            assert [(r["media_id"], round(r["score"], 9)) for r in postings.bm25_top(spark, path, wanted, k).collect()] == best


def test_blocks_below_the_best_are_passed_over(spark, tmp_path, library, monkeypatch):
    monkeypatch.setattr(postings, "FIRST", 1)
    docs, _ = library
    path = str(tmp_path / "index")
    postings.build(*postings.fulltext(docs, FIELDS), path)
    want = sorted(rows(search.bm25(docs, FIELDS, ["sea"])).items(), key=lambda x: (-x[1], x[0]))
    assert [(r["media_id"], round(r["score"], 9)) for r in postings.bm25_top(spark, path, ["sea"], 2).collect()] == want[:2]


def test_a_broken_write_is_not_seen(spark, tmp_path, library):
    docs, text = library
    path = str(tmp_path / "index")
    postings.build(*postings.fulltext(docs, FIELDS), path)
    before = rows(postings.bm25(spark, path, ["sea"]))
    new = spark.createDataFrame([(i * 3, "sea sea", None) for i in range(40)], docs.schema)
    postings.change(*postings.fulltext(new, FIELDS), docs.limit(0), path)
    after = rows(postings.bm25(spark, path, ["sea"]))
    shutil.rmtree(f"{path}/stats/generation=1")  # the write ended before its last step
    assert rows(postings.bm25(spark, path, ["sea"])) == before != after
    postings.change(*postings.fulltext(new, FIELDS), docs.limit(0), path)  # and is done again
    assert rows(postings.bm25(spark, path, ["sea"])) == after


def test_terms_and_empty_index(spark, tmp_path, library):
    docs, _ = library
    fields = {"description": "text", "keywords": "source"}
    path = str(tmp_path / "terms")
    postings.build(*postings.termed(docs, fields), path)
    want = sorted(map(tuple, search.term_recall(search.term_index(docs, fields), ["sea", "去", "1"]).collect()))
    assert sorted(map(tuple, postings.term_recall(spark, path, list(fields), ["sea", "去", "1"]).collect())) == want != []
    none = str(tmp_path / "none")
    postings.build(*postings.fulltext(docs.limit(0), FIELDS), none)
    assert postings.bm25(spark, none, ["sea"]).count() == 0 and postings.bm25_top(spark, none, ["sea"], 5).count() == 0
    nulls = docs.where("media_id = 0").withColumn("media_id", F.lit(None).cast("bigint"))
    postings.change(*postings.fulltext(nulls.unionByName(docs), FIELDS), docs.limit(0), none)
    assert rows(postings.bm25(spark, none, ["sea"])) == rows(search.bm25(docs, FIELDS, ["sea"]))


def test_rows_are_made_whole_where_a_block_meets(spark, tmp_path, monkeypatch):
    texts = ["Sea dog sea", "straße Élan 去年 x1", "--", "", None, "ÇA va là, sea", "𝔸bc 😀 sea٣", "a-b_c", "İstanbul ΣΑΣ"]
    docs = spark.createDataFrame([(i * i % 9001 - 50, texts[i % len(texts)], ["dog", "sea"][i % 2]) for i in range(900)], "media_id int, text string, source string").dropDuplicates(["media_id"])
    whole = postings.fulltext(docs, FIELDS)
    assert whole[0].columns == ["token", "block", "entries", "n", "max_tf", "min_d"]  # nothing is left to be merged
    assert whole[0].groupBy("token", "block").count().where("count > 1").count() == 0
    own = [search.tokens(F.coalesce(F.col(c), F.lit(""))) for c in FIELDS]
    weighed = lambda t, w: F.transform(t, lambda x: F.struct(x.alias("t"), F.lit(w).alias("w")))
    each = docs.select("media_id", (F.size(own[0]) + F.size(own[1])).alias("d"), F.explode(F.concat(*map(weighed, own, FIELDS.values()))).alias("e"))
    want = sorted(map(tuple, each.groupBy("media_id", "d", "e.t").agg(F.sum("e.w")).collect()))
    read = lambda made: sorted(map(tuple, made[0].select((F.col("block") * postings.SPAN).alias("b"), "token", F.explode("entries").alias("e")).select((F.col("b") + F.col("e.o")).alias("id"), "e.d", "token", "e.tf").collect()))
    assert read(whole) == want
    assert sorted(map(tuple, whole[1].collect())) == sorted(map(tuple, docs.select("media_id", F.size(own[0]) + F.size(own[1])).collect()))
    # blocks with much text: some rows of a token, no document in two, and the same searches
    monkeypatch.setattr(postings, "SLICE_BYTES", 200)
    monkeypatch.setattr(postings, "MOST_BYTES", 900)
    cut = postings.fulltext(docs, FIELDS)
    assert cut[0].groupBy("token", "block").count().where("count > 1").count() > 0 and read(cut) == want
    path = str(tmp_path / "i")
    postings.build(*cut, path)
    best = sorted(((r["media_id"], round(r["score"], 9)) for r in search.bm25(docs, FIELDS, ["sea"]).collect()), key=lambda r: (-r[1], r[0]))
    assert [(r["media_id"], round(r["score"], 9)) for r in postings.bm25_top(spark, path, ["sea"], 30).collect()] == best[:30]
