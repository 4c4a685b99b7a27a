"""Columns of a media row: keys, tags, orientation, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
AREA_CAP = 40_000_000
SEASONS = {"spring": ["03", "04", "05"], "summer": ["06", "07", "08"], "autumn": ["09", "10", "11"], "winter": ["12", "01", "02"]}


def place() -> Column:
    """City, else province, else country, of those that are not blank; null if none is."""
    return F.coalesce(*(F.expr(f"nullif(trim({c}), '')") for c in ("city", "province", "country")))


def tags(c: str) -> Column:
    return F.split(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), " ", ""), ",")


def weekday_order(c: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for k, d in enumerate(WEEKDAYS, 1) for x in (d, k)))[c], F.lit(8))


def cover_rank() -> Column:
    """A struct that is largest for the best cover of a group."""
    faces, own = F.col("face_count") > 0, tags("expression_tags")
    first = F.when(faces & F.array_contains(own, "happy"), 5).when(faces & F.array_contains(own, "neutral"), 4).when(faces, 3).when(F.col("person_count") > 0, 2).otherwise(1)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return F.struct(first.alias("first"), zero("preferred_face_quality"), zero("face_count"), zero("person_count"), "captured_at", "id")  # a null is below all


def cleanup_score() -> Column:
    """One number that orders near-duplicates: favourite, sharpness, area, smile, faces, persons, from high to low weight."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    area = F.least(F.log1p(F.col("width_px") * F.col("height_px")) / F.log1p(F.lit(float(AREA_CAP))), F.lit(1.0))
    few = lambda c: F.least(F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)), F.lit(99))
    sharp = F.round(unit(F.coalesce("sharpness_score", F.lit(0.0))) * 1000)
    smile = F.array_contains(tags("expression_tags"), "happy").cast("int")
    return (F.col("is_favorite") * 1e13 + sharp * 1e9 + F.round(area * 1000) * 1e6 + smile * 1e5 + few("face_count") * 1e3 + few("person_count")).cast("double")


def oriented() -> tuple[Column, Column]:
    """(aspect ratio to 3 places, layout) as shown: orientations 5 to 8 lie on their side."""
    side = F.col("raw_orientation").between(5, 8)
    w, h = (F.when(side, F.col(a)).otherwise(F.col(b)) for a, b in (("height_px", "width_px"), ("width_px", "height_px")))
    ratio = F.round(w / h, 3)
    return ratio, F.when(ratio > 2.5, "panorama").when(ratio > 1.2, "landscape").when(ratio < 0.8, "portrait").otherwise("square")
