"""Filters given as a dictionary, compiled to one predicate; scopes that need other tables become semi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.media import SEASONS, oriented, place, tags

_ALL, _ANY = (lambda x: reduce(Column.__and__, x, F.lit(True))), (lambda x: reduce(Column.__or__, x, F.lit(False)))
_PEOPLE = {"0": (0, 0), "1": (1, 1), "2": (2, 2), "3+": (3, None)}
_SECONDS = {"<=15": (None, 15), "<=60": (15, 60), "<=300": (60, 300), "<=1200": (300, 1200), ">1200": (1200, None)}
#: Longer and shorter side at least.
_SIZES = {"fhd": (1920, 1080), "uhd4k": (3840, 2160), "uhd8k": (7680, 4320)}


def _span(c: Column, low: float | None, high: float | None, open_: bool = False) -> Column:
    return _ALL([c > low if open_ else c >= low] * (low is not None) + [c <= high] * (high is not None))


def _resolution(kind: str) -> Column:
    long, short = F.greatest("width_px", "height_px"), F.least("width_px", "height_px")
    reaches = lambda k: (long >= _SIZES[k][0]) & (short >= _SIZES[k][1])
    above = {"sd": "fhd", "fhd": "uhd4k", "uhd4k": "uhd8k", "uhd8k": None}[kind]
    return _ALL(([reaches(kind)] if kind in _SIZES else []) + ([~reaches(above)] if above else []))


def compiled(filters: dict) -> Column:
    """The conjunction of what ``filters`` names; unknown names raise KeyError. Missing values fail, as in SQL."""
    month = F.substring("month_key", 6, 2)
    rules = {
        "location": lambda v: _ANY([place().isin([x for x in v if x != "unknown"])] + [place().isNull()] * ("unknown" in v)),
        "expression": lambda v: F.arrays_overlap(tags("expression_tags"), F.array(*map(F.lit, v))),
        "media_type": lambda v: F.col("media_type") == v,
        "year": lambda v: F.col("year_key").isin(v),
        "month": lambda v: F.col("month_key").isin(v),
        "weekday": lambda v: F.col("day_key").isin(v),
        "season": lambda v: month.isin([m for s in v for m in SEASONS[s]]),
        "month_of_year": lambda v: month.isin([f"{int(m):02d}" for m in v]),
        "dates": lambda v: F.col("date_key").between(*v),
        "people": lambda v: _ANY(_span(F.coalesce("person_count", F.lit(0)), *_PEOPLE[x]) for x in v),
        "analysed": lambda v: F.col("analysis_status_primary").isin("success", "failed") if v else F.col("analysis_status_primary").isNull() | ~F.col("analysis_status_primary").isin("success", "failed"),
        "faces": lambda v: (F.coalesce("face_count", F.lit(0)) > 0) == F.lit(bool(v)),
        "resolution": lambda v: _ANY(_resolution(x) for x in v),
        "duration": lambda v: _ANY(_span(F.col("duration_sec"), *_SECONDS[x], open_=True) for x in v),
        "layout": lambda v: oriented()[1].isin(v),
        "since": lambda v: F.col("created_at") >= F.lit(v).cast("timestamp_ntz"),
        "favorite": lambda v: F.col("is_favorite") == int(v),
    }
    return _ALL(rules[k](v) for k, v in filters.items())


def within(media: DataFrame, ids: DataFrame, column: str = "media_id") -> DataFrame:
    """The media that ``ids`` has."""
    return media.join(ids.select(F.col(column).alias("id")), "id", "left_semi")


def of_age(media: DataFrame, faces: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """Media with a face whose age is in one of the ranges."""
    return within(media, faces.where(_ANY(F.col("age").between(*r) for r in ranges)))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def after(df: DataFrame, cursor: int | None, size: int) -> DataFrame:
    """Keyset page: the next ``size`` rows below ``cursor``, highest id first."""
    return (df if cursor is None else df.where(F.col("id") < cursor)).orderBy(F.col("id").desc()).limit(size)
