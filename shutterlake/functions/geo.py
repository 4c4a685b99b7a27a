"""Coordinate systems (WGS-84, GCJ-02, BD-09) as column arithmetic, and points in boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the published GCJ-02 offset: the ellipsoid; per axis the polynomial's coefficients of
#: 1, x, y, (axis)^2, xy, sqrt|x|, then (amplitude, divisor, variable) of its sines.
SEMI_MAJOR, ECCENTRICITY_2 = 6378245.0, 0.00669342162296594323
CHINA = (72.004, 137.8347, 0.8293, 55.8271)
LAT = ((-100.0, 2.0, 3.0, 0.2, 0.1, 0.2), [(20, 1 / 6, "x"), (20, 1 / 2, "x"), (20, 1, "y"), (40, 3, "y"), (160, 12, "y"), (320, 30, "y")])
LNG = ((300.0, 1.0, 2.0, 0.1, 0.1, 0.1), [(20, 1 / 6, "x"), (20, 1 / 2, "x"), (20, 1, "x"), (40, 3, "x"), (150, 12, "x"), (300, 30, "x")])


def in_china(lng: Column, lat: Column) -> Column:
    return lng.between(*CHINA[:2]) & lat.between(*CHINA[2:])


def _offset(spec: tuple, x: Column, y: Column, squared: Column) -> Column:
    (c, cx, cy, c2, cxy, root), waves = spec
    poly = c + cx * x + cy * y + c2 * squared * squared + cxy * x * y + root * F.sqrt(F.abs(x))
    return poly + sum((a * F.sin({"x": x, "y": y}[v] * math.pi / d) for a, d, v in waves), F.lit(0.0)) * 2 / 3


def gcj_shift(lng: Column, lat: Column) -> tuple[Column, Column]:
    x, y, rad = lng - 105.0, lat - 35.0, F.radians(lat)
    magic = 1 - ECCENTRICITY_2 * F.pow(F.sin(rad), 2)
    d_lat = _offset(LAT, x, y, y) * 180 / (SEMI_MAJOR * (1 - ECCENTRICITY_2) / (magic * F.sqrt(magic)) * math.pi)
    d_lng = _offset(LNG, x, y, x) * 180 / (SEMI_MAJOR / F.sqrt(magic) * F.cos(rad) * math.pi)
    inside = in_china(lng, lat)
    return F.when(inside, d_lng).otherwise(0.0), F.when(inside, d_lat).otherwise(0.0)


def wgs_to_gcj(lng: Column, lat: Column) -> tuple[Column, Column]:
    d = gcj_shift(lng, lat)
    return lng + d[0], lat + d[1]


def gcj_to_wgs(lng: Column, lat: Column) -> tuple[Column, Column]:
    """The usual approximate inverse."""
    d = gcj_shift(lng, lat)
    return lng - d[0], lat - d[1]


def gcj_to_bd(lng: Column, lat: Column) -> tuple[Column, Column]:
    wave = math.pi * 3000 / 180
    z = F.hypot(lng, lat) + 0.00002 * F.sin(lat * wave)
    theta = F.atan2(lat, lng) + 0.000003 * F.cos(lng * wave)
    return z * F.cos(theta) + 0.0065, z * F.sin(theta) + 0.006


def bd_to_gcj(lng: Column, lat: Column) -> tuple[Column, Column]:
    wave = math.pi * 3000 / 180
    x, y = lng - 0.0065, lat - 0.006
    z = F.hypot(x, y) - 0.00002 * F.sin(y * wave)
    theta = F.atan2(y, x) - 0.000003 * F.cos(x * wave)
    return z * F.cos(theta), z * F.sin(theta)


def bd_to_wgs(lng: Column, lat: Column) -> tuple[Column, Column]:
    return gcj_to_wgs(*bd_to_gcj(lng, lat))


def wgs_to_bd(lng: Column, lat: Column) -> tuple[Column, Column]:
    return gcj_to_bd(*wgs_to_gcj(lng, lat))
