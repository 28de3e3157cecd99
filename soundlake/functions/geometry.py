"""Directions on the sphere: x right, y up, z forward; azimuth clockwise from the front in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def direction_vector(azimuth: Column, elevation: Column) -> Column:
    az, el = F.radians(azimuth), F.radians(elevation)
    return F.array(F.cos(el) * F.sin(az), F.sin(el), F.cos(el) * F.cos(az))


def norm(v: Column) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def as_doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def vector_direction(v: Column) -> Column:
    """STRUCT(azimuth, elevation, confidence); zeros for a vanishing or non-finite vector."""
    length = norm(v)
    usable = (length > 1e-9) & (length < float("inf")) & ~F.isnan(length)
    turn = F.degrees(F.atan2(v[0], v[2]))
    azimuth = F.when(turn < 0, turn + 360.0).otherwise(turn)
    azimuth = F.when(azimuth >= 360.0, F.lit(0.0)).otherwise(azimuth)
    elevation = F.degrees(F.atan2(v[1], F.hypot(v[0], v[2])))
    zero = F.lit(0.0)
    return F.struct(F.when(usable, azimuth).otherwise(zero).alias("azimuth"),
                    F.when(usable, elevation).otherwise(zero).alias("elevation"),
                    F.when(usable, F.least(length, F.lit(1.0))).otherwise(zero).alias("confidence"))


def angular_error(a: Column, b: Column) -> Column:
    """Degrees between two vectors, 180 when one of them vanishes."""
    la, lb = norm(a), norm(b)
    cosine = (a[0] * b[0] + a[1] * b[1] + a[2] * b[2]) / (la * lb)
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))
    return F.when((la <= 1e-9) | (lb <= 1e-9), F.lit(180.0)).otherwise(F.degrees(F.acos(bounded)))


def azimuth_quadrant(azimuth: Column) -> Column:
    a = F.pmod(azimuth, F.lit(360.0))
    return (F.when((a >= 315.0) | (a < 45.0), "front").when(a < 135.0, "right")
            .when(a < 225.0, "rear").otherwise("left"))


def elevation_band(elevation: Column) -> Column:
    return F.when(elevation < -20.0, "down").when(elevation > 20.0, "up").otherwise("level")


def uncertainty_lookup(table: Column, confidence: Column) -> Column:
    """Piecewise linear reading of ``ARRAY<STRUCT<confidence, p90>>`` (ascending), held at both ends."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    steps = F.filter(F.sequence(F.lit(0), F.size(table) - 1), lambda i: table[i]["confidence"] >= c)
    right = F.element_at(steps, 1)
    left = right - 1
    span = table[right]["confidence"] - table[left]["confidence"]
    share = F.when(span > 1e-6, (c - table[left]["confidence"]) / span).otherwise(F.lit(0.0))
    between = table[left]["p90"] + (table[right]["p90"] - table[left]["p90"]) * share
    return (F.when(F.size(table) == 0, F.lit(180.0))
            .when(F.size(steps) == 0, F.element_at(table, -1)["p90"])
            .when(right == 0, table[0]["p90"]).otherwise(between))
