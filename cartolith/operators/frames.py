"""Coordinate frames, boxes and clamps as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS = 6371009.0


def pixel(lon: Column, lat: Column, box: tuple[float, float, float, float], size: int) -> tuple[Column, Column]:
    """Raster pixel of a position in box = (west, south, east, north); y points down, truncation toward zero."""
    west, south, east, north = box
    return ((lon - west) / (east - west) * size).cast("long"), ((north - lat) / (north - south) * size).cast("long")


def boxes_overlap(box: tuple[Column, Column, Column, Column], other: tuple) -> Column:
    """Closed-edge overlap of (minx, miny, maxx, maxy); a null box overlaps."""
    minx, miny, maxx, maxy = box
    x0, y0, x1, y1 = other
    return F.coalesce((minx <= x1) & (maxx >= x0) & (miny <= y1) & (maxy >= y0), F.lit(True))


def box_around(lon: Column, lat: Column, distance: float) -> list[Column]:
    """(west, south, east, north) at a distance in metres."""
    dlat = math.degrees(distance / EARTH_RADIUS)
    dlon = F.lit(dlat) / F.cos(F.radians(lat))
    return [lon - dlon, lat - dlat, lon + dlon, lat + dlat]


def utm_zone(lon: Column, lat: Column) -> Column:
    zone = F.greatest(F.lit(1), F.least(F.lit(60), F.floor((lon + 180) / 6) + 1))
    return (zone + F.when(lat >= 0, 32600).otherwise(32700)).cast("long")


def rotated_corner(width: float, height: float, angle: float) -> list[tuple[int, float, float]]:
    """Five corners (closed) of a rectangle around the origin, rotated by angle degrees."""
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    corners = [(-width / 2, -height / 2), (width / 2, -height / 2), (width / 2, height / 2), (-width / 2, height / 2), (-width / 2, -height / 2)]
    return [(k, x * c - y * s, x * s + y * c) for k, (x, y) in enumerate(corners)]


def scaled(value: Column, factor: float) -> Column:
    return (value * F.lit(factor)).cast("long")


def centred(value: Column, size: int) -> Column:
    return value - size // 2


def frame_delta(base: int, extended: int, scale: float) -> int:
    """Pixels from the base frame's origin to the extended frame's, never negative."""
    return max(0, round((extended - base) / 2 * scale))


def outside_square(x: Column, y: Column, centre: int, half: int) -> Column:
    return ~((F.abs(x - centre) <= half) & (F.abs(y - centre) <= half))


def clamped(value: Column, low: int, high: int) -> Column:
    """Round half to even, then clamp."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.bround(value).cast("long")))


def decimation(size: Column) -> Column:
    """Factor by map size times four, one at least; sizes above 16384 are an error."""
    return F.when(size > 16384, F.raise_error(F.lit("map size above 16384"))).otherwise(F.greatest(F.lit(1), size.cast("long") * 4 / 16384).cast("long"))


def texture_resolution(size: Column) -> Column:
    return F.when(size <= 2048, 2048).when(size <= 8192, 4096).otherwise(8192).cast("long")


def spatial_rule_hits(features: DataFrame, rules: DataFrame) -> DataFrame:
    """Features whose box meets the box of some rule (small table) for their tag; null boxes never hit."""
    meets = (F.col("f.minx") <= F.col("r.x1")) & (F.col("f.maxx") >= F.col("r.x0")) & (F.col("f.miny") <= F.col("r.y1")) & (F.col("f.maxy") >= F.col("r.y0"))
    return features.alias("f").join(F.broadcast(rules).alias("r"), (F.col("f.k") == F.col("r.k")) & (F.col("f.v") == F.col("r.v")) & meets, "left_semi")
