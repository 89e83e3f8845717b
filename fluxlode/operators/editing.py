"""The edit loop: manual exclusion and smoothing as small tables of ids that are joined to the points, never as changes of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import series
from .spatial import inside_polygon

RAMPS = ("takeoff_ramp", "landing_ramp")


def is_ramp() -> Column:
    return F.coalesce(F.col("reason").isin(*RAMPS), F.lit(False))


def matching(points: DataFrame, lines: list[int] | None = None, ids: list[int] | None = None, polygons: list[list[tuple[float, float]]] | None = None) -> DataFrame:
    """(point_id) of the points of some lines, of some ids, or inside any of some rings of (lat, lon); rings of fewer than three corners hold none."""
    if lines is not None:
        found = F.col("line_id").isin(*lines)
    elif ids is not None:
        found = F.col("point_id").isin(*ids)
    else:
        rings = [inside_polygon(F.col("lon"), F.col("lat"), [(lon, lat) for lat, lon in r]) for r in polygons or [] if len(r) >= 3]
        if not rings:
            raise ValueError("give lines, ids or a polygon of at least three corners")
        found = reduce(lambda a, b: a | b, rings)
    return points.filter(found).select("point_id").distinct()


def set_exclusion(points: DataFrame, overrides: DataFrame | None, action: str, include_ramp: bool = False, **which) -> DataFrame:
    """(point_id, active): the overrides with those of the matching points set by `include` or `exclude`; ramps are left alone
    unless include_ramp says so."""
    if action not in ("include", "exclude"):
        raise ValueError(f"unknown action {action}")
    chosen = matching(points if include_ramp else points.filter(~is_ramp()), **which).withColumn("active", F.lit(action == "include"))
    return chosen if overrides is None else overrides.join(chosen, "point_id", "left_anti").unionByName(chosen)


def with_active(points: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """points with `active`: the override, else whether the point is on a line."""
    auto = F.col("line_id") >= 0
    if overrides is None:
        return points.withColumn("active", auto)
    forced = overrides.select("point_id", F.col("active").alias("_forced"))
    return points.join(forced, "point_id", "left").withColumn("active", F.coalesce("_forced", auto)).drop("_forced")


def exclusion_state(points: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    return with_active(points, overrides).select("point_id", (~F.col("active")).alias("excluded"))


def point_list(points: DataFrame, value: str, overrides: DataFrame | None = None) -> DataFrame:
    """What a map shows of each point: place, the chosen value, lines, whether it is excluded and whether it is on a ramp."""
    shown = with_active(points, overrides)
    return shown.select("point_id", *[c for c in ("lat", "lon", "x", "y") if c in points.columns], F.col(value).alias("value"), "line_id", "tie_line_id", (~F.col("active")).alias("excluded"), is_ramp().alias("is_ramp"))


def without_hidden_ramps(listed: DataFrame) -> DataFrame:
    return listed.filter(~(F.col("is_ramp") & F.col("excluded")))


def in_rectangle(listed: DataFrame, a: tuple[float, float], b: tuple[float, float], action: str) -> DataFrame:
    """(point_id) of the points between two corners whose state `action` would change."""
    (x0, x1), (y0, y1) = sorted((a[0], b[0])), sorted((a[1], b[1]))
    return listed.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1) & (F.col("excluded") != F.lit(action == "exclude"))).select("point_id")


def in_range(profile: DataFrame, start: float, end: float) -> DataFrame:
    """(point_id) of a line profile's points between two distances, in either order."""
    return profile.filter(F.col("distance_m").between(min(start, end), max(start, end))).select("point_id")


def add_smoothing(points: DataFrame, chosen: DataFrame | None, **which) -> DataFrame:
    """(point_id) of all points to be smoothed: those chosen before and the matching ones."""
    new = matching(points, **which)
    return new if chosen is None else chosen.unionByName(new).distinct()


def smoothed(points: DataFrame, chosen: DataFrame | None, values: tuple[str, ...] = ("anomaly", "tmi"), near: int = 5) -> DataFrame:
    """points with the chosen stretches of each line bridged by straight lines; always made from the untouched points, so edits never add up."""
    if chosen is None:
        return points
    flagged = points.join(chosen.select("point_id", F.lit(True).alias("_chosen")), "point_id", "left").withColumn("_chosen", F.coalesce("_chosen", F.lit(False)))
    for v in (v for v in values if v in points.columns):
        flagged = series.bridge(flagged, v, "_chosen", ["line_id"], ["t", "point_id"], near).withColumn(v, F.col("bridged")).drop("bridged")
    return flagged.drop("_chosen")
