"""What queries in words ask for: places, times and the rest, for tables of queries.

Places and the words of times are dictionary terms (``dictionary.matched``). Dates and years in figures are found by patterns,
as native columns: the pieces of a text between the matches of a pattern tell where each match begins. Of matches that overlap the
longest stays, a fold over the array; keyword groups stay where no date in figures has their place. The day that words like
"yesterday" count from is an argument, so results don't depend on the clock.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.operators.dictionary import matched, normalised, without

#: Words of times, as (label, kind, number, other words for it). The number is an offset, a month or a number of days.
TIME_WORDS = [
    ("今天", "relative_day", 0, ["今日"]), ("昨天", "relative_day", -1, ["昨日"]), ("前天", "relative_day", -2, []),
    ("今年", "relative_year", 0, []), ("去年", "relative_year", -1, []), ("前年", "relative_year", -2, []),
    ("本月", "relative_month", 0, ["这个月"]), ("上个月", "relative_month", -1, []),
    ("最近", "recent", 30, ["近来"]), ("最近几天", "recent", 7, ["近几天", "这几天"]),
    ("这周", "relative_week", 0, ["本周", "这星期", "本星期"]), ("上周", "relative_week", -1, ["上星期"]),
    ("本周末", "weekend", 0, ["这周末", "这星期周末", "本星期周末"]), ("上周末", "weekend", -1, ["上星期周末"]),
    ("春天", "season", 1, ["春季"]), ("夏天", "season", 2, ["夏季"]), ("秋天", "season", 3, ["秋季"]), ("冬天", "season", 4, ["冬季"]),
]
#: Chinese names of the months, and of the seasons as filters know them.
MONTHS = ["一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "十一", "十二"]
SEASONS = ["spring", "summer", "autumn", "winter"]
YEARS = {"前年": -2, "去年": -1, "今年": 0}
#: Dates in figures, as (kind, pattern, groups of year, month and day; 0: none).
_CN_MONTH = "(?:十二|十一|十|[一二三四五六七八九])月(?:份)?"
_NO_WORD = r"(?<![\p{L}\p{N}])"
PATTERNS = [
    ("said_month", f"(前年|去年|今年)({_CN_MONTH})", (1, 2, 0)),
    ("said_date", r"(前年|去年|今年)(\d{1,2})月(\d{1,2})[日号]?", (1, 2, 3)),
    ("said_month", r"(前年|去年|今年)(\d{1,2})月(?:份)?", (1, 2, 0)),
    ("absolute_date", _NO_WORD + r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?![\p{L}\p{N}])", (1, 2, 3)),
    ("absolute_date", _NO_WORD + r"(\d{4})年(\d{1,2})月(\d{1,2})[日号]?(?![\p{L}\p{N}])", (1, 2, 3)),
    ("absolute_month", _NO_WORD + r"(\d{4})[-/.](\d{1,2})(?![-/.0-9\p{L}\p{N}])", (1, 2, 0)),
    ("absolute_month", _NO_WORD + r"(\d{4})年(\d{1,2})月(?![\d\p{L}\p{N}])", (1, 2, 0)),
    ("absolute_year", _NO_WORD + r"(\d{4})年?(?![-/.月日号\d\p{L}\p{N}])", (1, 0, 0)),
]
#: Which kind of time decides where a query has several.
RANKS = {"absolute_date": 4, "relative_day": 4, "weekend": 4, "relative_week": 3, "absolute_month": 3, "relative_month": 3, "named_month": 3, "absolute_year": 2, "relative_year": 2, "recent": 1}
_SIGNAL = "struct<start: int, end: int, label: string, kind: string, dimension: string, value: string, from: string, to: string>"


def time_words() -> list[tuple[str, str, str, int]]:
    """(label, kind, term, number) of all words of times, months included."""
    out = [(label, kind, term, n) for label, kind, n, more in TIME_WORDS for term in (label, *more)]
    for n, name in enumerate(MONTHS, 1):
        figures = [str(n), f"{n:02d}"] if n < 10 else [str(n)]
        out += [(f"{name}月", "named_month", term + end, n) for term in (name, *figures) for end in ("月", "月份")]
    return out


def spans(text: Column, pattern: str) -> Column:
    """(start, end, match) of each match of ``pattern`` in ``text``, in order; characters from 0."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    length = lambda parts, n: F.length(F.array_join(F.slice(parts, F.lit(1), n), ""))

    def place(m: Column, k: Column) -> Column:
        start = length(between, k + 1) + length(found, k)
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("match"))

    return F.transform(found, place)


def _plain(pattern: str) -> str:
    """The pattern for a match alone, without what stands around it."""
    return pattern.replace(_NO_WORD, "^").split("(?!")[0]


def _filter(kind: Column, dimension: Column | None = None, value: Column | None = None, start: Column | None = None, end: Column | None = None) -> list[Column]:
    text = lambda c, name: (F.lit(None) if c is None else c).cast("string").alias(name)
    return [kind.alias("kind"), text(dimension, "dimension"), text(value, "value"), text(start, "from"), text(end, "to")]


def _pad(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def _reader(kind: str, pattern: str, groups: tuple[int, int, int], today: Column) -> Callable[[Column], Column]:
    """What makes a signal of a match of ``pattern``."""
    plain, own = _plain(pattern), "absolute_" + kind.split("_")[1]
    said = F.create_map(*(F.lit(x) for kv in YEARS.items() for x in kv))

    def signal(s: Column) -> Column:
        year, month, day = (F.regexp_extract(s["match"], plain, g) for g in groups)
        year = F.year(today) + F.element_at(said, year) if kind.startswith("said") else year.cast("int")
        if own == "absolute_year":
            parts = _filter(F.lit(own), F.lit("year"), year)
        elif own == "absolute_month":
            word = F.regexp_replace(month, "月(份)?$", "")
            named = F.array_position(F.array(*map(F.lit, MONTHS)), word).cast("int")
            number = F.when(named > 0, named).otherwise(word.try_cast("int"))
            parts = _filter(F.lit(own), F.lit("month"), F.concat(year.cast("string"), F.lit("-"), _pad(number)))
        else:
            key = F.concat(year.cast("string"), F.lit("-"), _pad(month.cast("int")), F.lit("-"), _pad(day.cast("int")))
            parts = _filter(F.lit(own), None, None, key, key)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("label"), *parts).cast(_SIGNAL)

    return signal


def figures(text: Column, today: Column) -> Column:
    """Time signals in figures; of overlapping ones the longest, then the first by label."""
    every = []
    for kind, pattern, groups in PATTERNS:
        own = F.transform(spans(text, pattern), _reader(kind, pattern, groups, today))
        if kind == "absolute_year":
            own = F.filter(own, lambda s: s["value"].cast("int").between(1900, 2100))
        elif kind == "said_month":
            own = F.filter(own, lambda s: F.substring_index(s["value"], "-", -1).cast("int").between(1, 12))
        every.append(own)
    order = F.transform(F.concat(*every), lambda s: F.struct((s["start"] - s["end"]).alias("o"), s["label"].alias("l"), s["start"].alias("at"), s.alias("s")))
    free = lambda acc, s: ~F.exists(acc, lambda a: (s["end"] > a["start"]) & (s["start"] < a["end"]))
    none = F.array().cast(f"array<{_SIGNAL}>")
    return F.aggregate(F.array_sort(order), none, lambda acc, o: F.when(free(acc, o["s"]), F.concat(acc, F.array(o["s"]))).otherwise(acc))


def keyword_filter(label: Column, today: Column) -> Column:
    """The filter of a time word by its label, as a struct (kind, dimension, value, from, to)."""
    week = F.trunc(today, "week").cast("date")
    day = lambda d: F.date_format(d, "yyyy-MM-dd")
    out: dict[str, Column] = {}
    for name, kind, n, _ in TIME_WORDS:
        if kind == "relative_day":
            own = _filter(F.lit(kind), None, None, day(F.date_add(today, n)), day(F.date_add(today, n)))
        elif kind == "relative_year":
            own = _filter(F.lit(kind), F.lit("year"), F.year(today) + n)
        elif kind == "relative_month":
            own = _filter(F.lit(kind), F.lit("month"), F.date_format(F.add_months(F.trunc(today, "month"), n), "yyyy-MM"))
        elif kind == "recent":
            own = _filter(F.lit(kind), None, None, day(F.date_add(today, -n)), day(today))
        elif kind == "relative_week":
            own = _filter(F.lit(kind), None, None, day(F.date_add(week, 7 * n)), day(F.date_add(week, 7 * n + 6)))
        elif kind == "weekend":
            own = _filter(F.lit(kind), None, None, day(F.date_add(week, 7 * n + 5)), day(F.date_add(week, 7 * n + 6)))
        else:
            own = _filter(F.lit(kind), F.lit("season"), F.lit(SEASONS[n - 1]))
        out[name] = F.struct(*own)
    for n, name in enumerate(MONTHS, 1):
        out[f"{name}月"] = F.struct(*_filter(F.lit("named_month"), F.lit("monthOfYear"), F.lit(f"{n:02d}")))
    cases = None
    for name, own in out.items():
        cases = F.when(label == name, own) if cases is None else cases.when(label == name, own)
    return cases


def time_signals(fixed: Column, words: Column, today: Column) -> Column:
    """All time signals of a normalised text, by place: those in ``figures``, and groups of ``words`` (matches of time words; a group is
    all matches of a label) of which no range meets a figure's. A signal's start and end are those of its first range. Both should
    be columns that are there already: lambdas find anew, for each word, what they are given as an expression."""
    hit = lambda r: F.exists(fixed, lambda a: (r["end"] > a["start"]) & (r["start"] < a["end"]))
    spoilt = F.transform(F.filter(words, hit), lambda r: r["label"])
    first = F.filter(words, lambda r: ~F.array_contains(spoilt, r["label"]) & ~F.exists(words, lambda o: (o["label"] == r["label"]) & (o["start"] < r["start"])))

    def signal(r: Column) -> Column:
        own = keyword_filter(r["label"], today)
        return F.struct(r["start"].alias("start"), r["end"].alias("end"), r["label"].alias("label"), *(own[c].alias(c) for c in ("kind", "dimension", "value", "from", "to"))).cast(_SIGNAL)

    return F.array_sort(F.concat(fixed, F.transform(first, signal)))


def primary_time(signals: Column) -> Column:
    """The signal that decides: of the highest rank, then the first in the text; null if there is none."""
    rank = F.create_map(*(F.lit(x) for kv in RANKS.items() for x in kv))
    ranked = F.transform(signals, lambda s: F.struct((-F.coalesce(F.element_at(rank, s["kind"]), F.lit(0))).alias("r"), s.alias("s")))
    return F.get(F.array_sort(ranked), F.lit(0))["s"]


def understood(queries: DataFrame, places: DataFrame, today: Column, column: str = "text") -> DataFrame:
    """``queries`` with what they ask for: ``normalised``, ``places`` (labels, each once, longest term first), ``time`` (the deciding
    signal), ``times`` (labels of all signals), ``residual`` and ``segments`` (what is left without the ranges of both).

    ``places`` is a dictionary (label, term). A null query is empty; one without signals has empty arrays and null ``time``.
    """
    spark = queries.sparkSession
    own = queries.withColumn("normalised", normalised(F.col(column)))
    names = places.select("label", normalised(F.col("term")).alias("term"))
    words = spark.createDataFrame([(label, term) for label, _, term, _ in time_words()], "label string, term string")
    own = own.withColumn("__figures", figures(F.col("normalised"), today))
    own = matched(own, names, "normalised").withColumnRenamed("matches", "__places")
    own = matched(own, words, "normalised").withColumnRenamed("matches", "__words")
    own = own.withColumn("__times", time_signals(F.col("__figures"), F.col("__words"), today))
    labels = F.transform("__times", lambda s: s["label"])
    kept = F.filter("__words", lambda w: F.array_contains(labels, w["label"]))
    by_size = F.array_sort(F.transform("__places", lambda p: F.struct((p["start"] - p["end"]).alias("n"), p["label"].alias("label"), p["start"].alias("at"))))
    ranges = lambda a: F.transform(a, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))
    pieces = without(F.col("normalised"), F.concat(ranges("__places"), ranges("__times"), ranges(kept)))
    out = own.select(*queries.columns, "normalised", F.array_distinct(F.transform(by_size, lambda p: p["label"])).alias("places"), primary_time(F.col("__times")).alias("time"), labels.alias("times"), pieces.alias("segments"))
    return out.withColumn("residual", F.array_join("segments", ""))


def merged_filters(time: Column, places: Column, dimension: Column, values: Column, start: Column, end: Column, location: Column) -> list[Column]:
    """Filters that a user set (dimension, values, from, to, location; nulls and empty arrays where unset, dimension 'all' too) with those of
    a query where the user set none."""
    free = dimension.isNull() | dimension.isin("", "all")
    take = free & time["dimension"].isNotNull()
    no_range = start.isNull() & time["from"].isNotNull()
    return [
        F.when(take, time["dimension"]).otherwise(dimension).alias("dimension"), F.when(take, F.array(time["value"])).otherwise(values).alias("values"),
        F.when(no_range, time["from"]).otherwise(start).alias("from"), F.when(no_range, time["to"]).otherwise(end).alias("to"),
        F.when(F.coalesce(F.size(location), F.lit(0)) > 0, location).otherwise(F.when(F.size(places) > 0, places)).alias("location")]
