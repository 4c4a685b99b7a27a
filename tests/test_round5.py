"""Searches of near hashes: all pairs, whatever way they are found, and few rows dealt for it; the latent space of all passages."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shutterlake.llm import latent
from shutterlake.operators import neighbours


def some_hashes(n):
    """Clusters, copies, chance, and rows that share a band."""
    rng = random.Random(n)
    base = [rng.getrandbits(64) for _ in range(n // 20)] + [0]
    return [rng.choice(base) ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(12))) for _ in range(n)]


@pytest.mark.parametrize("distance", [5, 8, 18])
@pytest.mark.parametrize("cells", [7, 1 << 22])
def test_near_hashes_are_all_and_once(monkeypatch, distance, cells):
    monkeypatch.setattr(neighbours, "FEW", 0)
    monkeypatch.setattr(neighbours, "CELLS", cells)
    h = some_hashes(160)
    own = np.array(h, np.uint64)
    near = lambda x, y: (h[x] ^ h[y]).bit_count() <= distance
    plain = lambda parts: sorted((int(x), int(y)) for a, b in parts for x, y in zip(a, b, strict=True))
    assert sorted((min(p), max(p)) for p in plain(neighbours.near_hashes(own, None, distance))) == [(x, y) for x in range(160) for y in range(x + 1, 160) if near(x, y)]
    assert plain(neighbours.near_hashes(own[:90], own[90:], distance)) == [(x, y) for x in range(90) for y in range(70) if near(x, y + 90)]
    assert plain(neighbours.near_hashes(own[:0], own, distance)) == []


def test_first_near_rows_from_many_tiles(spark, monkeypatch):
    for name in ("HASHES", "COMPARED"):
        monkeypatch.setattr(neighbours, name, 16)
    rows = [(k % 2, k, h - (1 << 63), k * 7 % 31) for k, h in enumerate(dict.fromkeys(some_hashes(120)))]
    df = spark.createDataFrame(rows, "user_id bigint, id bigint, h bigint, first bigint")
    for distance in (8, 18):
        want = []
        for u, k, h, f in rows:
            near = [(g, i) for v, i, x, g in rows if v == u and i != k and ((x ^ h) & (1 << 64) - 1).bit_count() <= distance]
            want += [(u, k, min([*near, (f, k)])[1])] if near else []
        assert sorted(map(tuple, neighbours.first_near(df, distance).collect())) == sorted(want)
        pairs = neighbours.hamming_pairs(df.drop("first"), distance)
        assert sorted((r["user_id"], r["a"], r["b"]) for r in pairs.collect()) == sorted((u, i, k) for u, i, x, _ in rows for v, k, y, _ in rows if u == v and i < k and ((x ^ y) & (1 << 64) - 1).bit_count() <= distance)


def test_hashes_are_not_dealt_over_and_over(spark, monkeypatch):
    dealt, real = [], neighbours.tiles
    monkeypatch.setattr(neighbours, "tiles", lambda *a: dealt.append(real(*a)) or dealt[-1])
    media = spark.range(12_000).select(F.lit(1).cast("bigint").alias("user_id"), "id", F.lit("2020-01-01").alias("created_at"), F.hex(F.xxhash64("id")).alias("image_phash"))
    got = neighbours.near_duplicates(media.withColumn("image_phash", F.lpad("image_phash", 16, "0")), F.lit(1.0), seeds=False)
    # nearest by chance: none or few
    assert got.count() < 10 and [t.count() for t in dealt] == [12_000]


def test_sums_of_runs(monkeypatch):
    rng = np.random.default_rng(2)
    rows, of = rng.standard_normal((50, 3)), rng.integers(0, 50, 400)
    first = rng.integers(0, 300, 60)
    n = rng.integers(1, 40, 60)
    assert np.allclose(latent._sums(rows, of, first, n), [rows[of[a : a + k]].sum(0) for a, k in zip(first, n, strict=True)])
    assert latent._sums(rows, of, first[:0], n[:0]).shape == (0, 3)
    monkeypatch.setattr(latent, "ENTRIES", 8)
    idf, q = rng.random(30) + 0.1, rng.standard_normal((30, 4))
    passages = [np.unique(rng.integers(-1, 30, k)) for k in rng.integers(1, 20, 90)]  # -1: a word that is left out
    got, want = np.zeros((2, 30, 4))
    latent._multiply(got, np.concatenate(passages), np.ones(sum(map(len, passages)), int), np.array([len(p) for p in passages]), idf, q)
    for p in passages:
        latent._add(want, p[p >= 0], idf, q)
    assert np.allclose(got, want)


def test_latent_space_is_that_of_all_documents(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(260)]
    texts = [" ".join(rng.choices(words[(i % 26) * 10 :][:12], k=rng.choice([0, 5, 20, 90]))) for i in range(5_000)] + [None, "none of these"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    items = [latent.Item(i, latent.Words(pa.array([" ".join(words[i * 10 : i * 10 + 10])])).hashes, np.zeros(0, np.uint64)) for i in range(26)]
    index = latent.indexed(docs, items)
    at = {w: int(np.searchsorted(index.vocabulary, latent.Words(pa.array([w])).hashes[0])) for w in words}
    df = np.zeros(len(index.vocabulary))
    for t in texts:
        for w in {w for w in (t or "").split() if w in at}:
            df[at[w]] += 1
    idf = np.log((len(texts) + 1) / (df + 1)) + 0.01
    matrix = []
    for t in [*texts, *(" ".join(words[i * 10 : i * 10 + 10]) for i in range(26))]:
        own = (t or "").split()
        for k in range(0, len(own), latent.PASSAGE):
            x = np.zeros(len(idf))
            for w in own[k : k + latent.PASSAGE]:
                if w in at:
                    x[at[w]] += idf[at[w]]
            matrix += [x / np.linalg.norm(x)] if x.any() else []
    gram = np.array(matrix).T @ np.array(matrix)
    v = index.latent / idf[:, None]
    # the 26 largest singular values stand out: their vectors' products with the passages, as by the exact matrix
    exact = np.linalg.eigh(gram)[0][::-1][:26]
    assert len(index.vocabulary) == 260 and np.allclose(np.einsum("ik,ij,jk->k", v, gram, v)[:26], exact, rtol=1e-3)
    assert np.abs(gram @ v[:, :26] - v[:, :26] * exact).max() < 3e-3 * exact[0]
