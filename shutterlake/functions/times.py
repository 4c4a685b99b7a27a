"""Times of media as columns: texts, milliseconds, weeks and months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def exif_ms(text: Column) -> Column:
    """Milliseconds of "yyyy:MM:dd HH:mm:ss", with an offset such as +08:00 or in the session's zone; null if it is no time."""
    return millis(F.try_to_timestamp(F.trim(text), F.lit("yyyy:MM:dd HH:mm:ss[XXX]")))


def iso_ms(text: Column) -> Column:
    """Milliseconds of an ISO 8601 time; null if it is none."""
    return millis(F.try_to_timestamp(F.trim(text)))


def iso_text(ms: Column) -> Column:
    """ISO 8601 in UTC to the millisecond."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_millis(ms), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def week(day: Column) -> tuple[Column, Column]:
    """Monday and Sunday of the week that ``day`` is in."""
    first = F.date_trunc("week", day).cast("date")
    return first, F.date_add(first, 6)


def month_shifted(day: Column, months: int) -> Column:
    """The month key (yyyy-MM) so many months later."""
    return F.date_format(F.add_months(F.trunc(day, "month"), months), "yyyy-MM")
