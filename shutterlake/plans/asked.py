"""Queries on what search texts ask for. The texts are made of the tables' orders, nations and regions; documents get names of places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.operators import dictionary, intents, segments
from shutterlake.plans.queries import Query
from shutterlake.sources.shared import dealt
from shutterlake.sources.views import base

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


TODAY = "2025-03-15"
_MONTH = "{array}('一', '二', '三', '四', '五', '六', '七', '八', '九', '十', '十一', '十二'){close}"
#: A search text by its order's number, and the time that it must be found to ask for: kind, dimension, value, from, to, and what is left of the text.
_CASES = [
    # a year right after a letter is no date, but its month is a word of its own
    ("n || ' Sunset ' || y || '年' || m || '月' || d || '日'", "named_month", "'monthOfYear'", "mm", None, None, "'sunset' || y || '年' || d || '日'"),
    ("n || '，' || y || '年' || m || '月' || d || '日'", "absolute_date", None, None, "ymd", "ymd", "'，'"),
    ("'Sunset in' || n || ', ' || y || '-' || m || '-' || d", "absolute_date", None, None, "ymd", "ymd", "'sunsetin,'"),
    ("'去年' || cn || '月' || n || ' Beach'", "absolute_month", "'month'", "'2024-' || mm", None, None, "'beach'"),
    ("cn || '月份 ' || r || '的照片'", "named_month", "'monthOfYear'", "mm", None, None, "'的照片'"),
    ("'昨天在' || n", "relative_day", None, None, "'2025-03-14'", "'2025-03-14'", "'在'"),
    ("'上周 ' || r || ' 上周 Dogs'", "relative_week", None, None, "'2025-03-03'", "'2025-03-09'", "'dogs'"),
    ("n || ' 冬天的 Mountain'", "season", "'season'", "'winter'", None, None, "'的mountain'"),
    ("r || '、' || y || '年'", "absolute_year", "'year'", "y", None, None, "'、'"),
    ("'最近几天 ' || n || ' 今年'", "relative_year", "'year'", "'2025'", None, None, "''"),
    ("'本周末 ' || n || ' 去年'", "weekend", None, None, "'2025-03-15'", "'2025-03-16'", "''"),
    ("'前年' || m || '月' || d || '号' || n", "absolute_date", None, None, "'2023-' || mm || '-' || dd", "'2023-' || mm || '-' || dd", "''"),
    ("'上个月 Cats and Dogs'", "relative_month", "'month'", "'2025-02'", None, None, "'catsanddogs'"),
    ("' '", None, None, None, None, None, "''"),
]
_ROWS = """SELECT o.o_orderkey AS id, o.o_orderkey % {cases} AS k, n.n_name AS n, r.r_name AS r, CAST(year(o.o_orderdate) AS {str}) AS y, CAST(month(o.o_orderdate) AS {str}) AS m,
  CAST(day(o.o_orderdate) AS {str}) AS d, lpad(CAST(month(o.o_orderdate) AS {str}), 2, '0') AS mm, lpad(CAST(day(o.o_orderdate) AS {str}), 2, '0') AS dd, {month}[month(o.o_orderdate) - {first}] AS cn
  FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey"""


def _case(i: int) -> str:
    own = lambda x: "NULL" if x is None else "y || '-' || mm || '-' || dd" if x == "ymd" else x
    return "CASE k " + " ".join(f"WHEN {k} THEN {own(c[i])}" for k, c in enumerate(_CASES)) + " END"


def searches(s: SparkSession, d: str) -> DataFrame:
    """(id, text): a search text for each order."""
    tables = {t: base(s, d, t) for t in ("orders", "customer", "nation", "region")}
    sql = _ROWS.format(cases=len(_CASES), str="STRING", month=_MONTH.format(array="array", close=""), first=1, **{t: "{" + t + "}" for t in tables})
    return s.sql(f"SELECT id, {_case(0)} AS text FROM ({sql})", **tables)


def _searches_sql() -> str:
    rows = _ROWS.format(cases=len(_CASES), str="VARCHAR", month="(" + _MONTH.format(array="list_value", close="") + ")", first=0, orders="orders", customer="customer", nation="nation", region="region")
    kind = "CASE k " + " ".join(f"WHEN {k} THEN {chr(39) + c[1] + chr(39) if c[1] else 'NULL'}" for k, c in enumerate(_CASES)) + " END"
    place = "CASE k " + " ".join(f"WHEN {k} THEN {'lower(replace(r, chr(32), chr(0)))' if ' r ' in f' {c[0]} ' else 'n'}" for k, c in enumerate(_CASES[:12])) + " END"
    return f"WITH t AS (SELECT *, {kind} AS kind, {_case(2)} AS dimension, {_case(3)} AS value, {_case(4)} AS first_day, {_case(5)} AS last_day, {_case(6)} AS residual, {place} AS place FROM ({rows}))\n"


def places(s: SparkSession, d: str) -> DataFrame:
    """(label, term): names of nations and regions."""
    return base(s, d, "nation").select(F.col("n_name").alias("label"), F.col("n_name").alias("term")).unionByName(base(s, d, "region").select(F.col("r_name").alias("label"), F.col("r_name").alias("term")))


def _understood(s: SparkSession, d: str) -> DataFrame:
    return intents.understood(searches(s, d), places(s, d), F.lit(TODAY).cast("date"))


_IS_REGION = ", ".join(str(k) for k, c in enumerate(_CASES) if " r " in f" {c[0]} ")
_HAS_PLACE = ", ".join(str(k) for k in range(12))
_SEARCHES = _searches_sql()
_add("query_times", lambda s, d: _understood(s, d).select("id", *(F.col(f"time.{c}").alias(a) for c, a in (("kind", "kind"), ("dimension", "dimension"), ("value", "value"), ("from", "first_day"), ("to", "last_day")))),
     _SEARCHES + "SELECT id, kind, dimension, value, first_day, last_day FROM t")
_add("query_residual", lambda s, d: _understood(s, d).select("id", F.array_join("places", "|").alias("places"), "residual"),
     _SEARCHES + f"SELECT id, CASE WHEN k IN ({_IS_REGION}) THEN r WHEN k IN ({_HAS_PLACE}) THEN n ELSE '' END AS places, residual FROM t")


def _filters(s: SparkSession, d: str) -> DataFrame:
    """Users have filters of their own for every second search: all times, or a year and a place."""
    own = _understood(s, d)
    mine: Column = F.col("id") % 4
    dimension, location = F.when(mine == 1, "all").when(mine == 3, "year"), F.when(mine == 3, F.array(F.lit("EUROPE")))
    merged = intents.merged_filters(F.col("time"), F.col("places"), dimension, F.when(mine == 3, F.array(F.lit("2024"))), F.lit(None).cast("string"), F.lit(None).cast("string"), location)
    out = own.select("id", *merged)
    return out.select("id", "dimension", F.array_join("values", "|").alias("values"), F.col("from").alias("first_day"), F.col("to").alias("last_day"), F.array_join("location", "|").alias("location"))


_add("query_filters", _filters, _SEARCHES + f"""SELECT id, CASE WHEN id % 4 = 3 THEN 'year' WHEN dimension IS NOT NULL THEN dimension WHEN id % 4 = 1 THEN 'all' END AS dimension,
  CASE WHEN id % 4 = 3 THEN '2024' WHEN dimension IS NOT NULL THEN value END AS values, first_day, last_day,
  CASE WHEN id % 4 = 3 THEN 'EUROPE' WHEN k IN ({_IS_REGION}) THEN r WHEN k IN ({_HAS_PLACE}) THEN n END AS location FROM t""")  # fmt: skip

# ---- whole documents between the names of a nation and of a region
_CAPTION = "concat('nation_', CAST(doc_id % 25 AS {str}), ' ', coalesce(text, ''), ' ', CASE doc_id % 5 WHEN 0 THEN 'Africa' WHEN 1 THEN 'America' WHEN 2 THEN 'Middle  East' WHEN 3 THEN 'Nation_7' ELSE '' END)"


def _captions(s: SparkSession, d: str) -> DataFrame:
    own = base(s, d, "documents").select("doc_id", dictionary.normalised(F.expr(_CAPTION.format(str="STRING"))).alias("text"))
    return dictionary.matched(own, places(s, d).select("label", dictionary.normalised(F.col("term")).alias("term")), cut=True)


# of these names none begins with another's end but a nation's with a longer number, so leftmost-longest is longest first
_NAMES = "nation_2[0-4]|nation_1[0-9]|nation_[0-9]|middleeast|america|africa|europe|asia"
_CAPTIONS = rf"WITH c AS (SELECT doc_id, lower(regexp_replace({_CAPTION.format(str='VARCHAR')}, '[\s\x{{A0}}\x{{3000}}\x{{FEFF}}]+', '', 'g')) AS text FROM documents)" + "\n"
_add("document_places", lambda s, d: _captions(s, d).select("doc_id", F.explode("matches").alias("m")).groupBy("doc_id", "m.label").agg(F.count("*").alias("n")).select("doc_id", "label", "n"),
     _CAPTIONS + f"SELECT doc_id, CASE WHEN m = 'middleeast' THEN 'MIDDLE EAST' ELSE upper(m) END AS label, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_NAMES}')) AS m FROM c) GROUP BY ALL")
_add("document_residual", lambda s, d: _captions(s, d).select("doc_id", F.md5("residual").alias("residual"), F.size("segments").alias("pieces")),
     _CAPTIONS + f"SELECT doc_id, md5(regexp_replace(text, '{_NAMES}', '', 'g')) AS residual, len(list_filter(string_split_regex(text, '{_NAMES}'), lambda x: x <> '')) AS pieces FROM c")


def _segments(s: SparkSession, d: str) -> DataFrame:
    """Words learned from all documents, in the documents without their white space. The best of all cuts is not SQL; a plain dynamic
    programme is in the tests."""
    docs = base(s, d, "documents")
    own = dealt(docs.select("doc_id", "text")).select("doc_id", dictionary.normalised(F.col("text")).alias("text"))
    return segments.segmented(own, segments.words_counted(docs)).select("doc_id", F.size("words").alias("n_words"), F.md5(F.array_join("words", " ")).alias("words"))


_add("document_segments", _segments)
_add("learned_words", lambda s, d: segments.words_counted(base(s, d, "documents")),
     r"""SELECT word, n FROM (SELECT CASE WHEN regexp_full_match(w, '[\x00-\x7F]+') THEN lower(w) ELSE w END AS word, count(*) AS n
FROM (SELECT unnest(string_split_regex(coalesce(text, ''), '[\s\x{3000},.;:!?、，。；：！？/\\|''"()\[\]{}]+')) AS w FROM documents) WHERE w <> '' GROUP BY ALL)
WHERE n >= 2 AND strlen(word) <= 48 ORDER BY n DESC, word LIMIT 200000""")  # fmt: skip
