"""Scalar expressions: names, safe casts, angles, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ordered keyword rules for asset names.
KEYWORDS = (("residential", ("house", "home", "almond", "antique")), ("farmyard", ("farm", "barn", "blush", "green")), ("industrial", ("factory", "steel", "metallic")))


def safe_name(name: Column, fallback: str = "unnamed") -> Column:
    """Everything but letters, digits, _ and - becomes _, outer _ go, lower case."""
    clean = F.lower(F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_\-]+", "_"), r"^_+|_+$", ""))
    return F.when(clean == "", fallback).otherwise(clean)


def plate_prefix(name: Column) -> Column:
    return F.rpad(F.upper(F.substring(name, 1, 3)), 3, " ")


def coordinate_stamp(lat: Column, lon: Column) -> Column:
    return F.replace(F.concat_ws("_", F.format_string("%.3f", lat), F.format_string("%.3f", lon)), F.lit("."), F.lit("_"))


def keyword_category(name: Column, default: str = "commercial") -> Column:
    low = F.lower(name)
    found = [F.when(low.rlike("|".join(words)), F.lit(category)) for category, words in KEYWORDS]
    return F.coalesce(*found, F.lit(default))


def optional_distance(text: Column) -> Column:
    """A positive number or null."""
    value = text.try_cast("double")
    return F.when(value > 0, value)


def radius_or(text: Column, fallback: float = 0.01) -> Column:
    value = text.try_cast("double")
    return F.when(value > 0, value).otherwise(fallback)


def folded(angle: Column) -> Column:
    """An axis direction in [-90, 90)."""
    return F.pmod(angle + 90, F.lit(180)) - 90


def visual_yaw(angle: Column, kind: Column, offset: Column) -> Column:
    """Lights keep their heading; other assets are mirrored, folded and offset, modulo 360."""
    return F.when(kind == "light", F.pmod(angle, F.lit(360))).otherwise(F.pmod(-folded(angle) + offset, F.lit(360)))


def strength(radius: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (radius - 8) / 22))
