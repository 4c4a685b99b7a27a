"""The operators of the training-data pipeline against plain versions, on small tables with hard cases."""

import collections
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from shutterlake.llm import chat, latent, linear, lm, order_minhash, packing, pii, pu_quality, quality_rules, queries, sharding, toxicity
from shutterlake.llm.common import fold, written

random.seed(3)
WORDS = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 7))) for _ in range(3000)]
EXTRA = "doc_id bigint, text string, n bigint, bucket string, score double"
LONG = " ".join(random.choice(WORDS) for _ in range(30_000))


def text(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def table(spark, texts, first=0):
    rows = [(first + i, t, 1, "b", 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, EXTRA)


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    own = [(0, None, None, None, None), (None, "a b c", 1, None, 0.1), (None, None, 1, "x", None), (1, "", 1, "x", 1.0), (2, "a b c", 1, "x", 1.0), (2, "a b c", 1, "x", 1.0), (3, LONG, 1, "x", 1.0), (4, "Ünï 字 \t\n", None, "x", 1.0), (5, "A B C", 1, "x", 1.0)]
    return spark.createDataFrame(own, EXTRA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(2, 1, 0), (3, 0, 1), (None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")


def edited(base, n, rng):
    words = base.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def shingles(t):
    w, seen, out = t.lower().split(), collections.Counter(), []
    for i in range(max(1, len(w) - 4) if w else 0):
        s = " ".join(w[i : i + 5])
        out.append((s, seen[s]))
        seen[s] += 1
    return out


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute_classes(texts):
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    own = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            both = len(set(own[i]) & set(own[j]))
            if texts[i] == texts[j] or own[i] and both >= 0.8 * (len(own[i]) + len(own[j]) - both) and (n := lcs(own[i], own[j])) >= 0.8 * (len(own[i]) + len(own[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in range(len(texts))}


@pytest.mark.parametrize("few", [32, 2])
def test_order_minhash_classes(spark, few, monkeypatch):
    """few = 2 sends all crowded buckets through the blocks, and splits keys of more than 3 rows in joins."""
    monkeypatch.setattr(order_minhash, "FEW", few)
    monkeypatch.setattr(order_minhash, "HOT", 3 if few == 2 else order_minhash.HOT)
    monkeypatch.setattr(order_minhash, "BLOCK", 16)
    rng = random.Random(4)
    base, passage = text(90), text(60)
    texts = [edited(base, rng.choice([0, 0, 1, 2, 3]), rng) for _ in range(70)] + [text(20) + " " + passage + " " + text(30) for _ in range(20)] + [base] * 5 + [text(80) for _ in range(10)]
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.classes(table(spark, texts)).collect()}
    assert got == brute_classes(texts)


def test_salted_is_the_join(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "HOT", 10)
    left = spark.createDataFrame([(7, i % 3) for i in range(95)] + [(8, i) for i in range(10)] + [(9, 0), (None, 5)], "k bigint, v bigint").repartition(3)
    right = spark.createDataFrame([(7, "a"), (8, "b"), (10, "c"), (None, "d")], "k bigint, w string")
    hot = order_minhash.hot_keys(left.groupBy("k").agg(F.count("*").alias("size")), ["k"], left.count())
    assert [tuple(r) for r in hot.collect()] == [(7, 10)]
    got = order_minhash.salted(left, right, ["k"], hot)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "k").collect()))
    assert order_minhash.salted(left.limit(0), right, ["k"], hot).count() == 0


def test_order_is_seen(spark):
    a, b = text(60), text(60)
    got = {r["class_id"] for r in order_minhash.classes(table(spark, [f"{a} {b}", f"{b} {a}"])).collect()}
    assert got == {0, 1}


def test_order_minhash_hard(spark, hard):
    got = order_minhash.classes(hard).collect()
    assert len(got) == hard.count()
    assert sorted(r["class_id"] for r in got if r["doc_id"] in (2, 5)) == [2, 2, 2]  # equal word by word, case apart
    kept = order_minhash.deduplicated(hard)
    assert kept.columns == hard.columns and kept.count() == 4  # empty, a b c, the long one, the one with marks
    assert order_minhash.classes(hard.limit(0)).count() == 0


def test_lm_against_counts(spark, hard):
    docs = table(spark, [text(40) for _ in range(60)] + [LONG], 10).unionByName(hard)
    held = F.coalesce(fold(F.col("doc_id"), 7) == 2, F.lit(False))
    got = lm.scored(docs, lm.Trained(docs.where(~held))).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), "</s>"]
    counts = collections.Counter()
    rows = docs.select("doc_id", "text").collect()
    for r in rows:
        if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            counts.update(split(r["text"]))
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((str(r["doc_id"]), len(w := split(r["text"])), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w), 4)) for r in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["train_tokens"] == total and r["score"] < 0 for r in got)
    parts = lm.Trained(docs.where(~held))
    parts.parts = [[k for p in parts.parts for k in p if k % 2 == i] for i in (0, 1)]  # as if the filter were too large for one
    again = lm.scored(docs, parts).collect()
    assert sorted(round(r["score"], 6) for r in again) == sorted(round(r["score"], 6) for r in got)
    assert lm.scored(docs.limit(0), lm.Trained(docs.limit(0))).count() == 0


def test_lm_knows_pairs_that_occur_once(spark):
    import pyarrow as pa

    texts = [" ".join(f"one{i}x{k}" for k in range(40)) for i in range(30)] + ["said twice"] * 2
    trained = lm.Trained(table(spark, texts))
    h, p, _ = lm.tokens(pa.array(texts))
    got = lm._levels(trained.part(0), h, p, trained.model.most)[1]
    assert trained.parts and (got >= 1).all() and (got[:-6] == 1).mean() > 0.9


def test_latent_finds_items_and_leaves_the_rest(spark, hard):
    items = [text(n) + "." for n in (16, 20, 37, 64, 150)]
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, "")], "item_id bigint, text string")
    clean = [text(200) for _ in range(80)]
    planted = [text(70) + " " + t + " " + text(50) for t in items] + [text(30) + " " + " ".join(w for k, w in enumerate(t.split()) if k % 8 != 2) + " " + text(30) for t in items]
    docs = table(spark, clean + planted, 100).unionByName(hard)
    got = {(r["doc_id"], r["item_id"]) for r in latent.leaks(docs, bench).collect()}
    assert got == {(180 + i, i % 5) for i in range(10)}
    left = latent.decontaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - 10
    assert latent.leaks(docs.limit(0), bench).count() == 0 and latent.leaks(docs, bench.limit(0)).count() == 0


def test_latent_finds_hot_reworded_passages(spark):
    """A passage that over 5% of the documents have with its rarest words changed, against verdict() at all places."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(9)
    hot = [f"hot{k}" for k in range(20)]
    items = [" ".join(hot), " ".join(f"cold{k}" for k in range(20))]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    changed = [hot if i % 9 == 0 else [*hot[:3], *(f"new{i}x{k}" for k in range(1 + i % 6)), *hot[4 + i % 6 :]] for i in range(400)]
    texts = [" ".join(rng.choices(WORDS, k=60)) + " " + " ".join(w) + " " + " ".join(rng.choices(WORDS, k=60)) for w in changed] + [" ".join(rng.choices(WORDS, k=140)) for _ in range(2100)]
    for t in [" ".join(["hot3", "hot4"] + WORDS[:3])] * 2 + [items[1]]:
        texts.append(t)
    docs = table(spark, [t.replace("hot3", "only") if 0 < i < 400 else t for i, t in enumerate(texts)])
    index = latent.indexed(docs, own := next(latent.items_of(bench)))
    rows = docs.select("doc_id", "text").collect()
    want = set()
    for r in rows:
        h = latent.Words(pa.array([r["text"]])).hashes
        for i, x in enumerate(own):
            places = range(0, max(1, len(h) - 59), 5)
            if np.isin(x.words, h).sum() >= 10 and any(latent.verdict(x, index.rare[i], h[p : p + 60]) for p in places):
                want.add((r["doc_id"], i))
    assert len(want) > 200
    assert {(r["doc_id"], r["item_id"]) for r in latent.leaks(docs, bench).collect()} == want


def test_subsequence_lengths_agree():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(1, 30)).astype(np.uint64), rng.integers(0, 6, rng.integers(0, 40)).astype(np.uint64)
        n = lcs(a.tolist(), b.tolist())
        assert latent.subsequence_length(a, b) == n == latent.common_subsequence(a, b)[0]


def test_subsequence_of_long_items_in_halves(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    monkeypatch.setattr(latent, "TABLE", 30)
    for _ in range(30):
        a, b = rng.integers(0, 6, rng.integers(1, 40)).astype(np.uint64), rng.integers(0, 6, rng.integers(0, 50)).astype(np.uint64)
        n, used = latent.common_subsequence(a, b)
        assert n == used.sum() == lcs(a.tolist(), b.tolist()) == lcs(a[used].tolist(), b.tolist())


def test_subsequence_beyond_two_bytes():
    import numpy as np

    words = np.random.default_rng(3).integers(0, 1 << 60, 40_000).astype(np.uint64)
    n, used = latent.common_subsequence(words, words)
    assert n == 40_000 and used.all()


def test_toxicity_changes_come_back():
    """What a task packs is what the mean is made of, within half precision."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    tasks = [(rng.normal(size=(2, 2 * toxicity.CHANGES)) * 50, (rng.random(2 * toxicity.CHANGES) < 0.3).astype(np.int32) * k) for k in (1, 3)]
    packed = [b for (x, shards) in tasks for b in toxicity.packed_changes(x[0].astype(np.float32), np.abs(x[1]).astype(np.float32), shards)]
    for k in range(2):
        group = pa.Table.from_batches([b for b in packed if b.column("k")[0].as_py() == k])
        got = np.frombuffer(toxicity.mean_changes(group).column("z")[0].as_py(), np.float32)
        own = slice(k * toxicity.CHANGES, (k + 1) * toxicity.CHANGES)
        n = sum(s[own] for _, s in tasks)
        want = sum(x[0][own] * (s[own] > 0) for x, s in tasks) / np.maximum(n, 1)
        assert np.allclose(got, want, atol=0.3) and (got[n == 0] == 0).all()


def test_toxicity_against_plain_ftrl_over_shards(spark):
    """Rounds over several shards against the rule written out: each shard goes on from the mean, which counts shards that met a word."""
    import numpy as np

    rng = random.Random(6)
    rows = [(i % 3, " ".join(rng.choice("abcdefgh") for _ in range(3)), i % 2) for i in range(60)]
    frame = spark.createDataFrame(rows, "shard int, text string, y int").repartition(2, "shard").sortWithinPartitions("shard")
    kept = written(frame)
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    order = collections.defaultdict(list)
    for r in kept.toArrow().to_pylist():
        _, (own,) = next(toxicity.documents(iter(spark.createDataFrame([(r["text"],)], "text string").toArrow().to_batches())))
        order[r["shard"]].append((own.tolist(), r["y"]))
    bias = math.log(30.5 / 30.5)
    for _ in range(3):
        sums = collections.defaultdict(lambda: [0.0, 0.0, 0])
        for own in order.values():
            a, b, met = dict(z), dict(n), set()
            for keys, y in own:
                w = {i: 0.0 if abs(a.get(i, 0.0)) <= toxicity.L1 else (math.copysign(toxicity.L1, a[i]) - a[i]) / ((toxicity.BETA + math.sqrt(b[i])) / toxicity.ALPHA) for i in keys}
                g = 1 / (1 + math.exp(-bias - sum(w.values()))) - y
                for i in keys:
                    before = b.get(i, 0.0)
                    a[i] = a.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / toxicity.ALPHA * w[i]
                    b[i] = before + g * g
                    met.add(i)
            for i in met:
                s = sums[i]
                s[0], s[1], s[2] = s[0] + a[i] - z[i], s[1] + b[i] - n[i], s[2] + 1
        for i, (dz, dn, k) in sums.items():
            z[i], n[i] = z[i] + dz / k, n[i] + dn / k
    got_bias, at, w = toxicity.fit(kept, rounds=3)
    want = {i: (math.copysign(toxicity.L1, z[i]) - z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA) for i in z if abs(z[i]) > toxicity.L1 + 0.02}
    got = dict(zip(at.tolist(), w.tolist(), strict=True))
    assert abs(got_bias - bias) < 1e-9 and set(want) <= set(got) and all(abs(got[i] - x) < 0.1 for i, x in want.items())


def test_toxicity_learns_and_bears_hard_rows(spark, hard, labels):
    bad = WORDS[:4]
    texts = [text(40) + (" " + " ".join(random.choices(bad, k=4)) if i % 3 == 0 else "") for i in range(400)]
    docs = table(spark, texts, 100)
    marks = spark.createDataFrame([(100 + i, 1, int(any(w in t.split() for w in bad))) for i, t in enumerate(texts)], labels.schema)
    out = toxicity.scored(docs, toxicity.trained(docs, marks, fold(F.col("doc_id"), 3) != 1)).join(marks, "doc_id").where(fold(F.col("doc_id"), 3) == 1).collect()
    right = sum((r[toxicity.SCORE] >= 0.5) == bool(r["toxic"]) for r in out)
    assert right >= 0.85 * len(out)
    model = toxicity.trained(hard, labels, F.lit(True))
    got = toxicity.scored(hard, model)
    assert got.count() == hard.count() and all(0 <= r[toxicity.SCORE] <= 1 for r in got.collect())
    none = toxicity.trained(hard, labels.limit(0), F.lit(True))
    assert {r[toxicity.SCORE] for r in toxicity.scored(hard, none).collect()} == {0.5}


def test_quality_counts(spark, hard, labels):
    docs = hard.unionByName(table(spark, ["a b c\na b c\nx #$ y a b c", text(60)], 50))
    got = {(r["doc_id"], r["n_words"]): r for r in quality_rules.rules(docs, labels).collect()}
    r = got[50, 12]
    assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (13, 2, 1, 9, True)  # the middle words are in no repeated window
    assert got[0, 0]["base_failed"] and not got[0, 0]["kept"]
    assert quality_rules.rules(docs.limit(0), labels).count() == 0


def noisy(t):
    return " ".join(w + "#%*"[len(w) % 3] * 3 for w in t.split())


@pytest.fixture(scope="module")
def rated(spark):
    """Good and noisy texts, two thirds of them labelled."""
    texts = [noisy(text(60)) if i % 4 == 0 else text(60) for i in range(1200)]
    docs = table(spark, texts, 100)
    labels = spark.createDataFrame([(100 + i, int(i % 4 > 0), 0) for i in range(1200) if i % 3], "doc_id bigint, quality int, toxic int")
    return docs, labels


def test_positive_unlabelled_learns(spark, rated):
    docs, labels = rated
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    weights, prior = pu_quality.trained(docs, labels, ~held)
    assert 0.65 <= prior <= 0.85
    got = pu_quality.scored(docs.where(held), weights).collect()
    assert sum((r["score"] >= 0.3) == ((r["doc_id"] - 100) % 4 > 0) for r in got) >= 0.95 * len(got) > 100


def test_positive_unlabelled_hard(spark, hard, labels):
    for marks in (labels, labels.limit(0)):
        weights, _ = pu_quality.trained(hard, marks, F.lit(True))
        got = pu_quality.scored(hard, weights).collect()
        assert len(got) == hard.count() and all(0 <= r["score"] <= 1 for r in got)
    weights, prior = pu_quality.trained(hard.limit(0), labels, F.lit(True))
    assert prior == 0.5 and {r["score"] for r in pu_quality.scored(hard, weights).collect()} == {0.5}
    assert pu_quality.scored(hard.limit(0), weights).count() == 0


def test_positive_unlabelled_uses_all_text_where_positives_are_rare(spark):
    """One row in a hundred is in P: all rows of U are learned from, and good and noisy text are still told apart."""
    import numpy as np

    texts = [noisy(text(60)) if i % 4 == 0 else text(60) for i in range(4000)]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(4000) if i % 4 and i % 67 == 0], "doc_id bigint, quality int, toxic int")
    held = F.col("doc_id") % 5 == 0
    rows = written(pu_quality.sample(docs, labels, ~held))
    used = 0
    for shard in {r["shard"] for r in rows.select("shard").distinct().collect()}:
        own = rows.where((F.col("shard") == shard) & ~F.col("held"))
        _, n = pu_quality.learned(iter(own.toArrow().to_batches()), np.zeros(linear.WIDTH), 0.75)
        assert own.where("spare").count() == pu_quality.SPARE and n == own.where("NOT spare").count()
        used += n
    assert used == rows.where("NOT spare AND NOT held").count() > 2500
    assert rows.where("NOT spare").count() == 3200
    weights, _ = pu_quality.fit(rows)
    got = [(r["score"], r["doc_id"] % 4 > 0) for r in pu_quality.scored(docs.where(held), weights).collect()]
    good, bad = ([s for s, y in got if y == k] for k in (True, False))
    assert sum(a > b for a in good for b in bad) >= 0.99 * len(good) * len(bad)


def test_derivatives_are_those_of_the_risk():
    import numpy as np

    rng = np.random.default_rng(2)
    for prior in (0.3, 0.9):
        z, p = rng.normal(size=40) * 2, rng.random(40) < 0.4

        def risk(z, p=p, prior=prior):
            loss = lambda x: np.log1p(np.exp(-x))
            return prior * loss(z[p]).mean() + max(0.0, loss(-z).mean() - prior * loss(-z[p]).mean())

        want = [(risk(z + e) - risk(z - e)) / 2e-5 for e in np.eye(40) * 1e-5]
        gp, got = pu_quality.non_negative(z[p], z, prior)
        got[p] += gp
        assert np.allclose(got, want, atol=1e-6)


def test_prior_and_scale_from_bins():
    import numpy as np

    p, u = np.zeros(pu_quality.BINS), np.zeros(pu_quality.BINS)
    p[600:700], u[600:700], u[300:400] = 1000, 700, 300  # a share of 0.7 of U is like P
    prior = pu_quality.prior_of(p, u)
    assert abs(prior - 0.7) < 0.01
    a, b = pu_quality.calibrated(p, u, prior)
    x = (np.arange(pu_quality.BINS) + 0.5) / 50 - 10
    h = 1 / (1 + np.exp(-(a * x + b)))
    assert abs((u * h).sum() / u.sum() - prior) < 0.02 and h[620] > 0.9 and h[380] < 0.1


def test_grams_against_plain_sums():
    """Values and derivatives of hashed n-grams against sums text by text."""
    import numpy as np
    import pyarrow as pa

    texts = ["", "a", "Ab cd", "die Straße führt zum Fluß 字 😀!", text(50), None, "x" * 9]
    rng = np.random.default_rng(3)
    w = rng.normal(size=linear.WIDTH)
    all_ = linear.Grams(linear.Words(pa.array(texts)))
    one = [linear.Grams(linear.Words(pa.array([t], pa.string()))) for t in texts]
    assert np.allclose(all_.logits(w), [x.logits(w)[0] for x in one])
    assert np.allclose(all_.logits(w, 2, 5), all_.logits(w)[2:5])
    g = rng.normal(size=len(texts))
    assert np.allclose(all_.gradient(g, 0, len(texts)), sum(x.gradient(g[i : i + 1], 0, 1) for i, x in enumerate(one)))
    assert np.isclose(all_.gradient(g, 0, len(texts)) @ w, g @ all_.logits(w))  # values are linear in the weights
    chars = lambda t: [t[i : i + n] for n in linear.CHARS for i in range(len(t) - n + 1)]
    for t, x in zip(texts, one, strict=True):
        assert sum(max(0, len(t or "") - n + 1) for n in linear.CHARS) == sum(max(0, int(x.sections[1][0][-1]) - n + 1) for n, _ in x.sections[1][1]) == len(chars(t or ""))


def test_quality_classifier_learns(spark, rated):
    docs, labels = rated
    got = {r["doc_id"]: r for r in quality_rules.rules(docs, labels).collect()}
    assert all(r["kept"] == ((k - 100) % 4 > 0) for k, r in got.items() if not r["base_failed"]) and len(got) == 1200
    bins = collections.Counter(round(r["quality"]) for r in got.values())
    assert abs(bins[1] - 900) < 30


def test_shards_do_not_depend_on_files(spark, rated):
    """The model is the same however the rows lie in files and tasks."""
    import numpy as np

    docs, labels = rated
    a, b = (quality_rules.fit(written(linear.examples(d, labels, "quality", F.lit(True)))) for d in (docs.repartition(1), docs.repartition(7)))
    assert np.allclose(a[0], b[0], atol=1e-6)


def test_toxicity_against_plain_ftrl(spark):
    """One shard's steps against the update rule written out for dictionaries."""
    import numpy as np

    rng = np.random.default_rng(4)
    docs, labels = [np.unique(rng.integers(0, 50, 8)) for _ in range(60)], rng.integers(0, 2, 60).tolist()
    z, n = np.zeros(1 << toxicity.BITS), np.zeros(1 << toxicity.BITS)
    toxicity.learned(docs, labels, z, n, -0.5)
    zs, ns = collections.defaultdict(float), collections.defaultdict(float)
    for own, y in zip(docs, labels, strict=True):
        w = {i: 0.0 if abs(zs[i]) <= toxicity.L1 else (math.copysign(toxicity.L1, zs[i]) - zs[i]) / ((toxicity.BETA + math.sqrt(ns[i])) / toxicity.ALPHA) for i in own.tolist()}
        g = 1 / (1 + math.exp(0.5 - sum(w.values()))) - y
        for i in w:
            zs[i] += g - (math.sqrt(ns[i] + g * g) - math.sqrt(ns[i])) / toxicity.ALPHA * w[i]
            ns[i] += g * g
    assert np.allclose([z[i] for i in zs], list(zs.values())) and np.allclose([n[i] for i in ns], list(ns.values()))


def test_pii_round_trip_and_links(spark, hard):
    value = "Mail jo.doe+x@site.org, card 4111 1111 1111 1111, call +1 (212) 555-0187, 10.20.30.40, ssn 219-09-9999, 2023-05-17, 31/12/1999, IBAN GB82 WEST 1234 5698 7654 32, not 4111 1111 1111 1112 or 2023-02-30. Or +44 20 7946 0958, +33 1 23 45 67 89, +49 30 12345678."
    docs = table(spark, [value, "again jo.doe+x@site.org", "no data"], 50).unionByName(hard)
    docs = docs.withColumn("found", F.lit(7)).withColumn("__has", F.lit("own"))  # names that the operator would like
    out = pii.rewritten(docs, "k")
    assert out.columns == [*docs.columns, "found_"]
    back = pii.rewritten(out.drop("found_"), "k", back=True)
    by = {r["doc_id"]: r for r in out.collect()}
    assert len(by[50]["found_"]) == 11 and by[50]["text"] != value and by[50]["__has"] == "own"
    assert "4111 1111 1111 1112" in by[50]["text"] and "2023-02-30" in by[50]["text"] and "+44 " in by[50]["text"]
    assert by[50]["found_"][0]["value"] == by[51]["found_"][0]["value"] != "jo.doe+x@site.org"
    want = sorted(str(r["text"]) for r in docs.collect())
    assert sorted(str(r["text"]) for r in back.collect()) == want
    assert pii.rewritten(docs.limit(0)).count() == 0


def test_pii_dates_stay_apart(spark):
    """Every day of 40 years in five forms: different ones stay different, and come back."""
    days = spark.range(0, 14_610).select(F.date_add(F.lit("1980-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    forms = ["yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "MM-dd-yyyy"]
    all_ = days.select(F.explode(F.array(*(F.date_format("d", f) for f in forms))).alias("text")).distinct().withColumn("own", F.col("text"))
    out = pii.rewritten(all_, "k").where(F.size("found") == 1).select("text", "own")
    n = all_.count()
    back = pii.rewritten(out, "k", back=True).agg(F.count("*"), F.count_if(F.col("text") == F.col("own"))).first()
    assert out.select("text").distinct().count() == n and tuple(back) == (n, n)


def test_pii_against_plain_feistel(spark):
    import hashlib

    def plain(d, tweak, key):
        n = len(d)
        x, y = int(d[: n // 2]), int(d[n // 2 :])
        h = lambda i, v: int(hashlib.sha256("|".join([key, f"{tweak}{n}", str(i), str(v)]).encode()).hexdigest()[:15], 16)
        for i in range(pii.ROUNDS):
            if i % 2 == 0:
                x = (x + h(i, y)) % 10 ** (n // 2)
            else:
                y = (y + h(i, x)) % 10 ** (n - n // 2)
        return f"{x:0{n // 2}d}{y:0{n - n // 2}d}"

    own = ["2079460958", "0123456", "99999999999999"]
    got = spark.createDataFrame([(d,) for d in own], "d string").select(pii.digits(F.col("d"), "phone", "k")).collect()
    assert [r[0] for r in got] == [plain(d, "phone", "k") for d in own]


def test_packing_is_whole(spark, hard):
    docs = hard.unionByName(table(spark, [text(random.randint(0, 900)) for _ in range(120)], 50))
    got = packing.pack(docs, keep_ids=True).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.public_tokenizers.path(packing.TOKENIZER))
    want = []
    for r in docs.collect():
        ids = [*own.encode(r["text"] or "", add_special_tokens=False).ids, packing.END_ID]
        for a in range(0, len(ids), packing.LENGTH):
            part = ids[a : a + packing.LENGTH]
            want.append((str(r["doc_id"]), a, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)), len(ids)))
    assert sorted(want) == sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got)
    # no more sequences than piece by piece, longest first, each into the fullest with room
    room = []
    for n in sorted((x[2] for x in want), reverse=True):
        fits = [k for k, x in enumerate(room) if x >= n]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= n
        else:
            room.append(packing.LENGTH - n)
    assert len(by) <= 1.03 * len(room) + 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_word_ids_are_the_tokenizers(spark):
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(6)
    parts = ["<|", "|>", "'", "''", "don't", "ß", "É", "字", "😀", "\x00", "\x1c", "\u00a0", "\u2028", "A", "bC", "...", "-", "1", "23", " ", "\n", "\t", "é", "€"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)]
    own = Tokenizer.from_file(packing.public_tokenizers.path(packing.TOKENIZER))
    ids, first = packing.word_encoder()()(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == own.encode(t, add_special_tokens=False).ids, repr(t)


def test_sharding_law(spark, hard):
    docs = hard.unionByName(table(spark, [text(9) for _ in range(300)], 50))
    got = sharding.digest(docs).collect()
    assert len(got) == docs.count()
    for k in range(24):
        own = [r for r in got if r["shard"] == k]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    assert all(r["grown_shard"] in (r["shard"], 24) for r in got) and any(r["grown_shard"] == 24 for r in got)
    rows = [(str(r["doc_id"]), len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.collect()]
    assert sorted(rows) == sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got)
    again = sharding.digest(docs.repartition(3)).collect()
    assert {(r["doc_id"], r["shard"]) for r in got} == {(r["doc_id"], r["shard"]) for r in again}
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"])) if r["shard"] == 3]
    assert order != sorted(order, key=str)
    assert sharding.digest(docs.limit(0)).count() == 0


def test_sharding_keeps_columns_of_like_names(spark, tmp_path):
    docs = table(spark, [text(5) for _ in range(40)]).withColumn("_shard", F.lit("mine")).withColumn("_place", F.lit(3)).withColumn("_bucket", F.lit(4))
    back = sharding.write_shards(docs, f"{tmp_path}/out")
    assert set(docs.columns) <= set(back.columns) and back.where("_shard = 'mine' AND _place = 3 AND _bucket = 4").count() == 40


def test_chat_keeps_maximal(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "bot", "ho"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "bot", "ho"), (4, 0, None, None), (None, 0, "user", "x"), (None, 0, "user", "x")]
    kinds = "conv_id bigint, turn bigint, role string, text string"
    got = {r["conv_id"]: (r["n_turns"], r["copies"]) for r in chat.render(spark.createDataFrame(turns, kinds)).collect()}
    assert got == {1: (2, 2), 4: (1, 1), None: (1, 1)}
    assert chat.render(spark.createDataFrame([], kinds)).count() == 0
    odd = spark.createDataFrame([(1, 0, "user", LONG, 5, 6)], kinds + ", n int, place int")
    assert chat.render(odd).first()["rendered"] == f"<|im_start|>user\n{LONG}<|im_end|>\n"


def test_lm_scores_are_those_of_the_levels(spark):
    """The score against the formula with levels from exact counts: the filter may only add what its false members add."""
    import numpy as np

    texts = [text(30) for _ in range(120)] + ["the same words again and again"] * 9
    got = {r["doc_id"]: r["score"] for r in lm.scored(table(spark, texts), lm.Trained(table(spark, texts))).collect()}
    split = [[*t.split(), "</s>"] for t in texts]
    words = collections.Counter(w for s in split for w in s)
    pairs = collections.Counter(p for s in split for p in zip(["<s>", *s], s, strict=False))
    lev = lambda n: int(lm.level(np.array([n]))[0])
    middle = {w: lm._MIDDLE[lev(n)] for w, n in words.items()}
    total = sum(middle.values())
    for i, s in enumerate(split):
        want = 0.0
        for h, w in zip(["<s>", *s], s, strict=False):
            up = lm._UP[lev(len(texts) if h == "<s>" else words[h])]
            a = lm.WEIGHT * up / (up + lm.MIX)
            want += math.log10(a * min(1.0, lm._LOW[lev(pairs[h, w])] / up) + (1 - a) * (middle[w] + 1) / (total + len(words) + 1))
        assert abs(got[i] - want) < 0.02 * abs(want)


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), d).count() == 0, name
    assert corpus_pipeline.run(spark, d).count() > 0


def test_queries_mark_folds_and_verdicts(spark):
    d = "/root/testdata/sf0.001"
    for name, mod, left, cut in (("op2_toxicity", 3, 1, 0.7), ("op7_pu_quality", 5, 0, 0.3), ("op1_lm_score", 7, 2, None)):
        got = queries.queries()[name](spark, d).collect()
        assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
        for r in got:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == left)
            assert cut is None or 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)


def test_queries_are_registered():
    assert {re.match(r"op\d+", k)[0] for k in queries.queries()} == {f"op{n}" for n in range(1, 14)}
