"""Points in polygons: areas and points meet in cells of a grid, so the join is by equality; then an exact even-odd test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From the finest level to the coarsest.
LEVELS = ["district", "city", "province", "country"]


def edges(rings: Column) -> Column:
    """The edges of all rings, as (x1, y1, x2, y2). With all of them in one even-odd test, holes are outside."""

    def of(ring: Column) -> Column:
        n = F.greatest(F.size(ring) - 1, F.lit(0))
        joined = lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))
        return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), joined)

    return F.flatten(F.transform(rings, of))


def inside(own: Column, x: Column, y: Column) -> Column:
    """Whether a ray from the point crosses the edges an odd number of times."""
    crossed = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x - e["x1"] < F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"]))
    return F.size(F.filter(own, crossed)) % 2 == 1


def located(points: DataFrame, shapes: DataFrame, cell: float = 1.0) -> DataFrame:
    """``points`` (id, lng, lat, ...) with place_id, level and name of the area that each is in: of several that of the finest level,
    then of the smallest box, then of the smallest place_id; null where no area is. Points keep their other columns.

    ``shapes``: (level, place_id, name, rings), and ``frame`` (x, y, unit) where rings are in units of ``unit`` from (x, y): points are
    brought into the frame, not rings out of it, so that those right on an edge are told by the numbers that the rings are given in.
    An area goes to each cell its box touches; a point is in one cell.
    """
    at = lambda c: F.floor(c / cell)
    frame = F.col("frame") if "frame" in shapes.columns else F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("unit"))
    own = shapes.select("level", "place_id", "name", edges(F.col("rings")).alias("e"), frame.alias("frame")).where(F.size("e") > 0)
    side = lambda f, k: f(F.transform("e", lambda e: e[k]))
    box = own.select("*", side(F.array_min, "x1").alias("w"), side(F.array_max, "x1").alias("o"), side(F.array_min, "y1").alias("s"), side(F.array_max, "y1").alias("n"))
    # a hair wider, as the box is rounded on its way out of the frame
    out = lambda c, axis, k: F.col(f"frame.{axis}") + F.col(c) * F.col("frame.unit") + k * 1e-9 * cell
    step = lambda a, b, axis: F.explode(F.sequence(at(out(a, axis, -1)), at(out(b, axis, 1))))
    spread = box.withColumn("cx", step("w", "o", "x")).withColumn("cy", step("s", "n", "y"))
    order = F.coalesce(*(F.when(F.col("level") == v, k) for k, v in enumerate(LEVELS)), F.lit(len(LEVELS)))
    unit = F.col("frame.unit")
    best = F.struct(order.alias("k"), ((F.col("o") - F.col("w")) * unit * (F.col("n") - F.col("s")) * unit).alias("area"), "place_id", "level", "name")
    asked = points.select(F.col("id").alias("__id"), "lng", "lat", at(F.col("lng")).alias("cx"), at(F.col("lat")).alias("cy"))
    x, y = ((F.col(c) - F.col(f"frame.{axis}")) / unit for c, axis in (("lng", "x"), ("lat", "y")))
    met = asked.join(spread, ["cx", "cy"]).withColumns({"x": x, "y": y}).where(F.col("x").between(F.col("w"), F.col("o")) & F.col("y").between(F.col("s"), F.col("n")))
    hit = met.where(inside(F.col("e"), F.col("x"), F.col("y"))).groupBy("__id").agg(F.min(best).alias("__best"))
    return points.join(hit, points["id"] == hit["__id"], "left").select(*(points[c] for c in points.columns), *(F.col("__best").getField(c).alias(c) for c in ("place_id", "level", "name")))
