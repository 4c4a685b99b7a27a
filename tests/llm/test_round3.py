"""Divergence of sources, hard negatives and mixing against plain versions, on small tables with hard cases."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from shutterlake.llm import divergence, lm, mixing, negatives
from shutterlake.llm.common import written

DOCS = "doc_id bigint, text string, lang string, source string, part string, value double"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, g, s, "x", 0.5) for i, t, g, s in rows], DOCS)


# ---- op11


def plain_audit(rows, least=3, top=200):
    rows = [(t or "", g or "", s or "") for _, t, g, s in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [[t.translate(lower) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)] for text, _, _ in rows]
    out = []
    for lang in {g for _, g, _ in rows}:
        own = [(s, f) for (_, g, s), f in zip(rows, found, strict=True) if g == lang]
        docs = collections.Counter(t for _, f in own for t in set(f))
        kept = sorted((t for t, n in docs.items() if n >= least), key=str.encode)
        counts = {s: collections.Counter() for s, _ in own}
        for s, f in own:
            counts[s].update(t for t in f if docs[t] >= least)
        whole = sum(counts.values(), collections.Counter())

        def shares(c, kept=kept):
            return [1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept]

        q, p = shares(whole), {s: shares(c) for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(o, sum(map(f, p[s], p[o]))) for o in counts if o != s]
            words = [(t, f(a, b)) for t, a, b in zip(kept, p[s], q, strict=True) if counts[s][t] and a > b]
            for part, items in (("pair", pairs), ("term", words)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


@pytest.mark.parametrize("cells", [1 << 21, 8])
def test_audit_is_the_plain_one(spark, cells, monkeypatch):
    """cells = 8 makes many chunks of a language's terms (in the driver's part; tasks take the width from what they are sent)."""
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence.Language, "width", lambda self, n=max(1, cells // 4): n)
    rng = random.Random(1)
    words = ["sea", "Sea", "SEA", "Ünï", "ünï", "字", "x1y", "a", "zz", "\U0001f600", "don't"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "ß", None])) for i in range(90)]
    rows += [(None, "sea sea", "en", "s1")] * 3 + [(7, "one two", "xx", "a"), (7, "one two", "xx", "b"), (8, "", "yy", "a"), (9, None, "zz", "only")] + [(10, "sea " * 20_000, "en", "s2")]
    got = sorted(map(tuple, divergence.audited(documents(spark, rows).repartition(3)).collect()))
    assert got == plain_audit(rows)
    assert divergence.audited(documents(spark, rows).limit(0)).count() == 0


def test_audit_bounds_terms_and_sources(spark, monkeypatch):
    rows = [(i, " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)), "en", f"s{i % 2}") for i in range(4)] + [(9, "waa", "en", "s0")]
    got = sorted(map(tuple, divergence.audited(documents(spark, rows), top=5).collect()))
    assert got == plain_audit(rows, top=5)
    monkeypatch.setattr(divergence, "MOST_GROUPS", 1)
    with pytest.raises(ValueError, match="sources"):
        divergence.audited(documents(spark, rows))


def test_shares_are_exact():
    import numpy as np

    count, total = np.array([0, 7, 9 * 10**14, 10**15 - 1]), np.array([3, 10**9 + 7, 10**15, 10**15])
    assert divergence.probabilities(count, total).tolist() == [1 + 10**9 * (int(c) + 1) // int(t) for c, t in zip(count, total, strict=True)]


# ---- op12


def plain_negatives(rows, every=50, k=5, m=3, low=50, high=95):
    fit = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, label, q in sorted(fit):
        if i % every == 0:
            anchors.setdefault(i, (label, q))
    out = []
    for a, (label, q) in anchors.items():
        scores = [(-sum(x * y for x, y in zip(q, v, strict=True)), i, g) for i, g, v in fit if len(v) == len(q)]
        best = sorted((s, i) for s, i, g in scores if g == label and i != a)[:k]
        for s, i in best:
            hard = sorted((n, j) for n, j, g in scores if g != label and 50 * -s <= 100 * -n <= 95 * -s)[:m]
            out += [(a, i, r, j, -s, -n) for r, (n, j) in enumerate(hard, 1)]
    return sorted(out)


VECTORS = "vec_id bigint, label int, embedding array<float>, score double, w string"


@pytest.mark.parametrize(("anchors", "digit", "scale"), [(4096, 9, 1.0), (3, 3, 1.0), (4096, 9, 40.0)])
def test_negatives_are_the_plain_ones(spark, anchors, digit, scale, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    monkeypatch.setattr(negatives, "DIGIT", digit)
    rng = random.Random(5)
    vector = lambda n=6: [rng.choice([-0.5, 0.0, 0.25, 0.3, 0.9]) * scale for _ in range(n)]
    rows = [(i, rng.randrange(3), vector()) for i in range(0, 300, 2)]
    rows += [(i, 1, rows[10][2]) for i in range(1, 60, 2)]  # many of one vector, so scores tie
    rows += [(None, 1, vector()), (301, None, vector()), (303, 1, None), (305, 1, [0.1, None, 0.1, 0.1, 0.1, 0.1]), (307, 1, [float("nan")] + vector(5)), (309, 1, [float("inf")] + vector(5))]
    rows += [(311, 1, vector(3)), (350, 2, vector(3)), (313, 2, vector(3)), (315, 0, vector(3)), (317, 1, []), (50, 2, vector())]  # other lengths; an anchor's id again
    frame = spark.createDataFrame([(*r, 0.1, "x") for r in rows], VECTORS)
    got = sorted(map(tuple, negatives.mined(frame.repartition(3), F.col("vec_id") % 50 == 0).collect()))
    got = sorted((a, p, r, n, sp, sn) for a, p, r, n, sp, sn in got)
    import numpy as np

    exact = [(i, g, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, g, v in rows]
    assert got == plain_negatives(exact) != []
    assert negatives.mined(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_negatives_of_long_norms(spark):
    """Beyond 2 ** 24 products are in float64, beyond 2 ** 53 in whole numbers, beyond a long they are refused."""
    for size in (1e3, 1e5):
        rows = [(i, i % 2, [size * (i % 5 + 1), size * (i % 3) + 0.3]) for i in range(60)]
        frame = spark.createDataFrame([(*r, 0.1, "x") for r in rows], VECTORS.replace("float", "double"))
        assert sorted(map(tuple, negatives.mined(frame, F.col("vec_id") % 50 == 0).collect())) == plain_negatives(rows)
    with pytest.raises(ValueError, match="long"):
        negatives.mined(spark.createDataFrame([(0, 1, [1e9], 0.1, "x")], VECTORS.replace("float", "double")), F.col("vec_id") % 50 == 0)


def test_relabelled(spark):
    rows = spark.createDataFrame([(7, 9), (8, 9), (14, None), (0, 3)], "vec_id bigint, label int")
    assert [tuple(r) for r in negatives.relabelled(rows).collect()] == [(7, 0), (8, 9), (14, None), (0, 4)]


# ---- op13


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Reshares what is over the bounds by weight, round by round."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        for s in over or open_:
            out[s] = most * sizes[s] if over else level * weight[s]
            left -= out[s]
        open_ -= over or open_
    return out


@pytest.fixture(scope="module")
def mix(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(["sea", "dog", "#1!", "字"]) for _ in range(n))
    rows = [(i, text(rng.randrange(0, 30)), "en", rng.choice(["a", "a", "a", "a", "b", "c", "é", None])) for i in range(500)]
    rows += [(None, "x y", "en", "c")] * 40 + [(3, None, "en", "b"), (4, "", None, "empty"), (5, text(4000), "en", "b"), (6, "\t\n", "en", "a")]
    return documents(spark, rows), rows


def test_targets_are_those_of_the_rounds(spark, mix):
    docs, rows = mix
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = plain_targets(sizes)
    got = {r["source"]: r for r in mixing.targets(mixing.keyed(docs)).collect()}
    assert {s: r["source_size"] for s, r in got.items()} == sizes
    assert all(abs(got[s]["target"] - want[s]) < 1e-6 for s in want) and abs(sum(want.values()) - 1.5 * sum(sizes.values())) < 1e-6
    rng = random.Random(2)
    for _ in range(4):
        sizes = {chr(97 + i): rng.choice([0, 1, 5, 300, 10_000]) for i in range(9)}
        frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")
        want = plain_targets(sizes)
        assert all(abs(r["target"] - want[r["source"]]) < 1e-6 for r in mixing.targets(frame).collect())


def test_mix_takes_what_the_order_gives(spark, mix):
    """Whole epochs, then documents in the order of their keys while that brings the sum nearer to the target."""
    docs, rows = mix
    keys = written(mixing.keyed(docs)).collect()
    plan = {r["source"]: r for r in mixing.targets(mixing.keyed(docs)).collect()}
    want = []
    for source, p in plan.items():
        start = 0
        for r in sorted((k for k in keys if k["source"] == source), key=lambda k: k["x"]):
            inside = start + r["size"] / 2 <= p["rest"]
            want.append((str(r["doc_id"]), r["size"], p["source_size"], round(p["target"], 6), r["size"] * (p["epochs"] + inside)))
            start += r["size"]
    out = mixing.mixed(docs).collect()
    plain = lambda rs: sorted((str(r["doc_id"]), r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in rs)
    assert plain(out) == sorted(want) and len(out) == len(rows)
    assert all(r["taken"] <= 2 * r["size"] for r in out)
    assert plain(mixing.mixed(docs.repartition(7)).collect()) == plain(out)  # reruns agree, however rows lie
    for source, p in plan.items():
        ids = {i for i, _, _, s in rows if s == source}
        taken = sum(r["taken"] for r in out if r["source_size"] == p["source_size"] and r["doc_id"] in ids)
        largest = max((k["size"] for k in keys if k["source"] == source), default=0)
        assert abs(taken - p["target"]) <= largest / 2 + 1e-6


def test_mix_prefers_better_documents(spark):
    rows = [(i, "sea dog sun " * 5 if i % 2 else "1 ! 2 # 3 " * 5, "en", "a" if i < 1000 else "b") for i in range(1300)]
    docs = documents(spark, rows)
    out = mixing.mixed(docs, weights=(1, 9), share=0.5).collect()
    part = [r for r in out if r["doc_id"] < 1000]
    good, bad = (sum(r["taken"] > 0 for r in part if r["doc_id"] % 2 == k) for k in (1, 0))
    assert good > 2 * bad


def test_mix_hard(spark, mix):
    docs, _ = mix
    assert mixing.mixed(docs.limit(0)).count() == 0
    none = mixing.mixed(documents(spark, [(1, None, "en", None), (2, "", None, "a")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in none] == [(0, 0.0, 0)] * 2
    one = mixing.mixed(documents(spark, [(None, "a b", "en", "s")] * 9)).collect()  # rows repeated exactly are taken one by one
    assert sorted(r["taken"] for r in one) == [2] * 5 + [4] * 4 or sorted(r["taken"] for r in one) == [2] * 4 + [4] * 5
    assert "PythonUDF" not in (plan := mixing.mixed(docs)._jdf.queryExecution().executedPlan().toString()) and "InArrow" not in plan and "InPandas" not in plan


def test_texts_go_to_the_language_model_in_small_batches(spark, monkeypatch):
    name, whole = "spark.sql.execution.arrow.maxBytesPerBatch", lm.slices
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.lit("sea dog sun "), 25_000).alias("text")).coalesce(1)

    def small(batches):
        for batch in batches:
            assert batch.nbytes < 6 << 20, batch.nbytes
            yield from whole([batch])

    monkeypatch.setattr(lm, "slices", small)
    old = spark.conf.get(name)
    got = lm.scored(docs, lm.Trained(docs)).collect()
    assert spark.conf.get(name) == old and len(got) == 60 and {(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got} == {(75_001, 75_001, 60 * 75_001)}
