"""Dictionary matches and time expressions against plain walks."""

import datetime
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from shutterlake.operators import dictionary, intents, segments

TODAY = datetime.date(2025, 3, 15)


def plain_matches(text, rows):
    """Longest terms first, then by label; each takes the places that are free."""
    seen, taken, out = set(), [], []
    for _, label, term in sorted({(-len(t), name, t) for name, t in rows if t}):
        if term in seen:
            continue
        seen.add(term)
        at = text.find(term)
        while at >= 0:
            if all(at + len(term) <= a or at >= b for a, b in taken):
                taken.append((at, at + len(term)))
                out.append((at, at + len(term), label, term))
            at = text.find(term, at + 1)
    return sorted(out)


def plain_rest(text, taken):
    out, at = [], 0
    for a, b, *_ in taken:
        out.append(text[at:a])
        at = b
    return [x for x in [*out, text[at:]] if x]


@pytest.mark.parametrize("letters", ["ab", "abc去年字ü"])
def test_matches_are_those_of_the_walk(spark, letters):
    rng = random.Random(len(letters))
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    rows = [(f"L{rng.randrange(9)}", word(rng.randrange(1, 6))) for _ in range(25)] + [("L0", ""), (None, "a"), ("L1", None)]
    texts = [(i, word(rng.randrange(0, 60))) for i in range(120)] + [(200, ""), (201, None), (202, word(50_000))]
    got = dictionary.matched(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(rows, "label string, term string"), cut=True).collect()
    rows = [(a, b) for a, b in rows if a and b]
    assert len(got) == len(texts)
    for r in got:
        text = dict(texts)[r["id"]] or ""
        if len(text) > 1000:
            assert r["residual"] == "".join(r["segments"]) and sum(m["end"] - m["start"] for m in r["matches"]) + len(r["residual"]) == len(text)
            continue
        want = plain_matches(text, rows)
        assert [(m["start"], m["end"], m["label"], m["term"]) for m in r["matches"]] == want
        assert r["segments"] == plain_rest(text, want) and r["residual"] == "".join(r["segments"])


def test_empty_dictionary_and_size_bound(spark, monkeypatch):
    texts, none = spark.createDataFrame([(1, "abc")], "id int, text string"), spark.createDataFrame([], "label string, term string")
    assert dictionary.matched(texts, none, cut=True).first().asDict() == {"id": 1, "text": "abc", "matches": [], "residual": "abc", "segments": ["abc"]}
    monkeypatch.setattr(dictionary, "MOST_BYTES", 3)
    with pytest.raises(ValueError, match="bytes"):
        dictionary.matched(texts, spark.createDataFrame([("ab", "cd")], "label string, term string"))


def plain_times(text):
    """The deciding filter of a text, written out by hand over the same words and patterns."""
    found = []
    for kind, pattern, (y, m, d) in intents.PATTERNS:
        for x in re.finditer(pattern.replace(r"\p{L}\p{N}", r"\w"), text):
            year = TODAY.year + intents.YEARS[x[y]] if kind.startswith("said") else int(x[y])
            if kind.endswith("year"):
                own = ("absolute_year", "year", str(year), None, None) if 1900 <= year <= 2100 else None
            elif kind.endswith("month"):
                name = re.sub("月(份)?$", "", x[m])
                month = intents.MONTHS.index(name) + 1 if name in intents.MONTHS else int(name)
                own = ("absolute_month", "month", f"{year}-{month:02d}", None, None) if kind[0] != "s" or 1 <= month <= 12 else None
            else:
                day = f"{year}-{int(x[m]):02d}-{int(x[d]):02d}"
                own = ("absolute_date", None, None, day, day)
            if own:
                found.append((-len(x[0]), x[0], x.start(), x.end(), own))
    taken, out = [], []
    for _, label, a, b, own in sorted(found):
        if all(b <= c or a >= e for c, e in taken):
            taken.append((a, b))
            out.append((a, label, own))
    groups = {}
    for a, b, label, _ in plain_matches(text, [(name, term) for name, _, term, _ in intents.time_words()]):
        groups.setdefault(label, []).append((a, b))
    numbers = {name: (kind, n) for name, kind, _, n in intents.time_words()}
    monday = TODAY - datetime.timedelta(TODAY.weekday())
    for label, own in groups.items():
        if any(a < e and b > c for a, b in own for c, e in taken):
            continue
        kind, n = numbers[label]
        days = lambda a, b: (kind, None, None, str(a), str(b))  # noqa: B023, E731
        step = datetime.timedelta
        if kind == "relative_day":
            f = days(TODAY + step(n), TODAY + step(n))
        elif kind == "relative_year":
            f = (kind, "year", str(TODAY.year + n), None, None)
        elif kind == "relative_month":
            f = (kind, "month", f"{TODAY.year}-{TODAY.month + n:02d}", None, None)
        elif kind == "recent":
            f = days(TODAY - step(n), TODAY)
        elif kind == "relative_week":
            f = days(monday + step(7 * n), monday + step(7 * n + 6))
        elif kind == "weekend":
            f = days(monday + step(7 * n + 5), monday + step(7 * n + 6))
        elif kind == "season":
            f = (kind, "season", intents.SEASONS[n - 1], None, None)
        else:
            f = (kind, "monthOfYear", f"{n:02d}", None, None)
        out.append((own[0][0], label, f))
    out.sort()
    best = sorted(out, key=lambda s: -intents.RANKS.get(s[2][0], 0))
    return (best[0][2] if best else None), [label for _, label, _ in out]


def test_times_are_those_of_the_plain_parser(spark):
    rng = random.Random(8)
    bits = [term for _, _, term, _ in intents.time_words()] + ["去年六月", "今年12月31日", "前年3月", "去年十一月份", "2024-05-03", "2024.5", "2023年7月", "1999年", "2150年", "2024年13月9号", "今年13月", "，", "a", "在", "7", "月", " "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 6))) for _ in range(600)] + [t for _, _, t, _ in intents.time_words()] + ["", "去年六月", "三月", "冬天", "昨天", "上周", "本周末", "最近"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    none = spark.createDataFrame([], "label string, term string")
    got = intents.understood(frame, none, F.lit(str(TODAY)).cast("date")).collect()
    seen = set()
    for r in got:
        time, labels = plain_times(re.sub(r"\s+", "", texts[r["id"]]).lower())
        own = r["time"] and tuple(r["time"][c] for c in ("kind", "dimension", "value", "from", "to"))
        assert (own, r["times"]) == (time, labels), texts[r["id"]]
        seen.add(own and own[0])
    assert seen >= set(intents.RANKS) | {"season", None}


def test_understood_hard_rows(spark):
    frame = spark.createDataFrame([(1, None, 2), (2, "", 3), (3, "去年在 Paris 和 paris", 4)], "id int, text string, time int")
    places = spark.createDataFrame([("FR", "Paris"), ("X", " ")], "label string, term string")
    frame = frame.withColumnRenamed("time", "other")
    got = {r["id"]: r for r in intents.understood(frame, places, F.lit("2025-03-15").cast("date")).collect()}
    assert [(got[i]["places"], got[i]["time"], got[i]["residual"], got[i]["segments"]) for i in (1, 2)] == [([], None, "", [])] * 2
    assert (got[3]["places"], got[3]["time"]["value"], got[3]["segments"]) == (["FR"], "2024", ["在", "和"])
    assert intents.understood(frame.limit(0), places, F.lit("2025-03-15").cast("date")).count() == 0


def plain_words(text, counts):
    """The best cut by a plain dynamic programme, from whole weights; of equal sums the longer last word."""
    total = sum(counts.values())
    weight = {w: round(math.log2(n / total) * segments.SCALE) for w, n in counts.items()}
    best = [(0, 0)] + [None] * len(text)
    for i in range(1, len(text) + 1):
        options = []
        for k in range(i):
            w = weight.get(text[k:i], round(math.log2(0.5 / total) * segments.SCALE) if i - k == 1 else None)
            if w is not None:
                options.append((best[k][0] + w, len(text[k:i].encode()), k))
        best[i] = max(options)[0], max(options)[2]
    out, i = [], len(text)
    while i:
        out.append(text[best[i][1] : i])
        i = best[i][1]
    return out[::-1]


def test_segments_are_those_of_a_plain_programme(spark):
    rng = random.Random(12)
    letters = "abc天去年海"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    counts = {word(rng.randrange(1, 5)): rng.randrange(1, 90) for _ in range(40)}
    texts = [(i, word(rng.randrange(0, 40)) + rng.choice(["", "zz", "ü"])) for i in range(150)] + [(200, ""), (201, None), (202, word(30_000))]
    frame, words = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(list(counts.items()), "word string, n int")
    for r in segments.segmented(frame, words).collect():
        text = dict(texts)[r["id"]] or ""
        assert "".join(r["words"]) == text
        if len(text) < 1000:
            assert r["words"] == plain_words(text, counts), text
    for r in segments.segmented(frame.where("id < 150"), words, search=True).collect():
        want = []
        for w in plain_words(dict(texts)[r["id"]], counts):
            for n in (2, 3):
                want += [w[i : i + n] for i in range(len(w) - n + 1) if n < len(w) and w[i : i + n] in counts]
            want.append(w)
        assert r["words"] == want
    assert [r["words"] for r in segments.segmented(frame.limit(3), words.limit(0)).collect()] == [list(t) for _, t in texts[:3]]


def test_search_words(spark):
    words = spark.createDataFrame([("小狗", 9), ("海边", 5), ("海边小狗", 2), ("在", 7)], "word string, n int")
    texts = spark.createDataFrame([(1, "A Dog, (Beach)/dog"), (2, "海边小狗在 Beach2024 跑"), (3, None), (4, "")], "id int, text string")
    got = {r["id"]: r["tokens"] for r in segments.search_words(texts, words, stops=["在"]).collect()}
    assert got == {1: ["a", "dog", "beach"], 2: ["海边", "小狗", "海边小狗", "beach2024", "跑"], 3: [], 4: []}
