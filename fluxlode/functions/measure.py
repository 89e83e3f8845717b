"""Lengths, areas and colours of what is drawn on a map, as column expressions over arrays of struct<lat, lon>."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import haversine_km

EARTH_M = 6_371_008.8
DEGREE_M = math.pi / 180 * EARTH_M


def path_length_m(path: Column) -> Column:
    """Sum of the great-circle distances between neighbours; 0 for fewer than two points."""
    legs = F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda i: haversine_km(F.get(path, i - 1)["lat"], F.get(path, i - 1)["lon"], F.get(path, i)["lat"], F.get(path, i)["lon"]))
    return F.when(F.size(path) > 1, 1000 * F.aggregate(legs, F.lit(0.0), lambda a, b: a + b)).otherwise(0.0)


def polygon_area_m2(ring: Column) -> Column:
    """Shoelace area on metres that are true at the ring's mean latitude; 0 for fewer than three corners."""
    n = F.size(ring)
    middle = F.aggregate(ring, F.lit(0.0), lambda a, p: a + p["lat"]) / n
    cross = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ring, i)["lon"] * F.get(ring, (i + 1) % n)["lat"] - F.get(ring, (i + 1) % n)["lon"] * F.get(ring, i)["lat"])
    return F.when(n > 2, F.abs(F.aggregate(cross, F.lit(0.0), lambda a, b: a + b)) / 2 * DEGREE_M * DEGREE_M * F.cos(F.radians(middle))).otherwise(0.0)


def circle(lat: Column, lon: Column, radius_m: Column, corners: int = 16) -> Column:
    """Corners of a circle about a place, beginning in the east and going north."""
    turn = lambda i: 2 * math.pi * i / corners
    return F.transform(F.sequence(F.lit(0), F.lit(corners - 1)), lambda i: F.struct((lat + radius_m * F.sin(turn(i)) / DEGREE_M).alias("lat"), (lon + radius_m * F.cos(turn(i)) / (DEGREE_M * F.cos(F.radians(lat)))).alias("lon")))


def scale_position(value: Column, low: float, high: float, stops: list[float] | None = None) -> Column:
    """Where a value stands on a colour bar from 0 to 1: along the stops, which are evenly spaced on the bar, or linearly.
    Along stops nothing leaves the bar, and a missing value stands at 0."""
    if not stops or len(stops) < 2:
        return (value - low) / ((high - low) or 1)
    last = len(stops) - 1
    out = F.when(value.isNull() | F.isnan(value) | (value <= stops[0]), 0.0).when(value >= stops[last], 1.0)
    for k in range(last - 1, -1, -1):
        width = stops[k + 1] - stops[k]
        out = out.when(value >= stops[k], (k + ((value - stops[k]) / width if width > 0 else F.lit(0.0))) / last)
    return out


def scale_colour(position: Column, anchors: list[tuple[int, int, int]]) -> Column:
    """#rrggbb of a position on a bar of evenly spaced anchor colours, by straight lines between them."""
    last = len(anchors) - 1
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), position)) * last
    k = F.least(F.floor(at), F.lit(last - 1)).cast("int")
    channel = lambda c: F.round(F.get(F.array(*[F.lit(a[c]) for a in anchors]), k) * (1 - (at - k)) + F.get(F.array(*[F.lit(a[c]) for a in anchors]), k + 1) * (at - k)).cast("int")
    return F.format_string("#%02x%02x%02x", channel(0), channel(1), channel(2))
