"""Joins on time: interpolation between neighbours, diurnal correction, observatories and clock lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import bearing_deg, haversine_km


def interpolate_at(left: DataFrame, right: DataFrame, value: str, out: str, hour: float = 3600.0, t: str = "t") -> DataFrame:
    """left with `out`, right's value at left's time: linear between neighbours, the end's value outside.

    right has one row a time. Both sides are dealt to spans of `hour` seconds; each span also gets the last known
    value before it and the first one after it, so no window covers all of time.
    """
    span = lambda c: F.floor(c / hour)
    r = right.select(F.col(t).alias("_t"), F.col(value).alias("_v")).filter(F.col("_t").isNotNull() & F.col("_v").isNotNull())
    edges = r.groupBy(span(F.col("_t")).alias("_span")).agg(F.min(F.struct("_t", "_v")).alias("_lo"), F.max(F.struct("_t", "_v")).alias("_hi"))
    spans = left.select(span(F.col(t)).alias("_span")).distinct().join(edges, "_span", "full")
    # one row per span with data: a short table, ordered in one window
    w = Window.orderBy("_span")
    spans = spans.select("_span", F.last("_hi", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_lo", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    points = left.withColumn("_span", span(F.col(t))).withColumn("_k", F.struct(F.col(t).alias("_t"), F.lit(None).cast("double").alias("_v")))
    known = r.select(span(F.col("_t")).alias("_span"), F.struct("_t", F.col("_v").cast("double").alias("_v")).alias("_k"))
    both = points.unionByName(known, allowMissingColumns=True).withColumn("_is", F.col("_k._v").isNotNull())
    # both neighbours are carried on over running frames, one for each direction of time
    have, whole = F.when(F.col("_is"), F.col("_k")), (Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("_span").orderBy(F.col("_k._t"), F.desc("_is")).rowsBetween(*whole)
    back = Window.partitionBy("_span").orderBy(F.desc("_k._t"), F.desc("_is")).rowsBetween(*whole)
    both = both.withColumn("_p", F.last(have, True).over(ahead)).withColumn("_n", F.last(have, True).over(back))
    got = both.filter(~F.col("_is")).join(F.broadcast(spans), "_span", "left")
    p, n = F.coalesce("_p", "_before"), F.coalesce("_n", "_after")
    line = p["_v"] + (n["_v"] - p["_v"]) * (F.col("_k._t") - p["_t"]) / (n["_t"] - p["_t"])
    exact = F.when(p["_t"] == F.col("_k._t"), p["_v"]).when(n["_t"] == F.col("_k._t"), n["_v"])
    return got.withColumn(out, F.coalesce(exact, line, p["_v"], n["_v"])).select(*left.columns, out)


def diurnal_correction(points: DataFrame, base: DataFrame, mag: str = "mag_raw", offset_s: float = 0.0, reference: str | float = "mean") -> DataFrame:
    """points with base_mag and corrected = mag - (base at that time - reference).

    reference: mean (over the base rows inside the survey's time, or all if none is), first, or a number.
    """
    shifted = base.select((F.col("t") + offset_s).alias("t"), F.col("mag").cast("double").alias("mag")).groupBy("t").agg(F.min("mag").alias("mag"))
    if isinstance(reference, str):
        ends = points.agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
        inside = F.when(F.col("t").between(F.col("_a"), F.col("_b")), F.col("mag"))
        every = shifted.crossJoin(F.broadcast(ends)).agg(F.coalesce(F.avg(inside), F.avg("mag")).alias("mean"), F.min_by("mag", "t").alias("first"))
        ref = every.select(F.col(reference).alias("_ref"))
    else:
        ref = points.sparkSession.createDataFrame([(float(reference),)], "_ref double")
    out = interpolate_at(points, shifted, "mag", "base_mag").crossJoin(F.broadcast(ref))
    return out.withColumn("corrected", F.col(mag) - (F.col("base_mag") - F.col("_ref"))).drop("_ref")


def diurnal_coverage(points: DataFrame, base: DataFrame) -> DataFrame:
    """One row: share of the points inside the base's time, and whether any lies outside."""
    ends = base.agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    inside = F.col("t").between(F.col("_a"), F.col("_b")).cast("double")
    return points.crossJoin(F.broadcast(ends)).agg((F.avg(inside) * 100).alias("coverage_pct"), (F.min(inside) < 1).alias("extrapolated"))


def apply_gps_lag(df: DataFrame, lag_s: float, keys=("source_file_index",)) -> DataFrame:
    """x and y of each row at its time plus lag_s, along its own track; rows moved off the track's ends go."""
    w = Window.partitionBy(*keys).orderBy("t", "point_id")
    legs = df.select(*keys, "t", "x", "y", F.lead("t").over(w).alias("_t1"), F.lead("x").over(w).alias("_x1"), F.lead("y").over(w).alias("_y1"))
    legs = legs.filter(F.col("_t1") > F.col("t")).withColumn("_cell", F.explode(F.sequence(F.floor("t"), F.floor("_t1"))))
    legs = legs.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("t").alias("_t0"), F.col("x").alias("_x0"), F.col("y").alias("_y0"), "_t1", "_x1", "_y1", "_cell")
    moved = df.withColumn("_at", F.col("t") + lag_s)
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    on = (F.floor("_at") == F.col("_cell")) & (F.col("_at") >= F.col("_t0")) & (F.col("_at") < F.col("_t1"))
    for s in same:
        on = on & s
    share = (F.col("_at") - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))
    out = moved.join(legs, on)
    last = [c for c in df.columns if c not in ("x", "y")]
    return out.select(*last, (F.col("_x0") + share * (F.col("_x1") - F.col("_x0"))).alias("x"), (F.col("_y0") + share * (F.col("_y1") - F.col("_y0"))).alias("y"))


def day_coverage(df: DataFrame, t: str = "t") -> DataFrame:
    """(day, coverage): share of the day's 1,440 minutes that have a value."""
    minute = F.floor(F.col(t) / 60)
    return df.groupBy(F.floor(F.col(t) / 86400).alias("day")).agg((F.count_distinct(minute) / 1440.0).alias("coverage"))


def fill_missing_days(df: DataFrame, good: float = 0.5, most_gap: int = 5) -> DataFrame:
    """(minute, mag, filled): a value for every minute from the first to the last day. Days with enough minutes give a
    template, the median deviation from the day's mean at each minute of the day; other days take the template plus the overall mean. Inside good
    days, gaps of up to most_gap minutes are interpolated."""
    minutes = df.groupBy(F.floor(F.col("t") / 60).alias("minute")).agg(F.avg("mag").alias("mag")).withColumn("day", F.floor(F.col("minute") / 1440))
    days = minutes.groupBy("day").agg((F.count("*") / 1440.0).alias("coverage"), F.avg("mag").alias("mean"))
    fine = days.filter(F.col("coverage") >= good)
    template = minutes.join(F.broadcast(fine), "day").groupBy((F.col("minute") % 1440).alias("of_day")).agg(F.median(F.col("mag") - F.col("mean")).alias("dev"))
    level = fine.agg(F.avg("mean").alias("level"))
    ends = minutes.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    grid = ends.select(F.explode(F.sequence("a", "b")).alias("day")).select("day", F.explode(F.sequence(F.lit(0), F.lit(1439))).alias("of_day")).withColumn("minute", F.col("day") * 1440 + F.col("of_day"))
    grid = grid.join(minutes.select("minute", "mag"), "minute", "left").join(F.broadcast(days.select("day", "coverage")), "day", "left").join(F.broadcast(template), "of_day", "left").crossJoin(F.broadcast(level))
    w = Window.partitionBy("day").orderBy("minute")
    known = F.when(F.col("mag").isNotNull(), F.struct("minute", "mag"))
    p, n = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    grid = grid.withColumn("_p", p).withColumn("_n", n)
    gap = F.col("_n.minute") - F.col("_p.minute") - 1
    inside = F.when(gap <= most_gap, F.col("_p.mag") + (F.col("_n.mag") - F.col("_p.mag")) * (F.col("minute") - F.col("_p.minute")) / (F.col("_n.minute") - F.col("_p.minute")))
    bad = F.coalesce(F.col("coverage"), F.lit(0.0)) < good
    value = F.when(bad, F.col("level") + F.col("dev")).otherwise(F.coalesce("mag", inside))
    return grid.select("minute", value.alias("mag"), (bad | F.col("mag").isNull()).alias("filled")).filter("mag is not null")


def rank_observatories(stations: DataFrame, lat: Column, lon: Column, most: int) -> DataFrame:
    """The nearest stations with distance_km and bearing_deg; ties go by code."""
    out = stations.withColumn("distance_km", haversine_km(lat, lon, F.col("lat"), F.col("lon"))).withColumn("bearing_deg", bearing_deg(lat, lon, F.col("lat"), F.col("lon")))
    return out.orderBy("distance_km", "iaga_code").limit(most)


def diverse_observatories(ranked: DataFrame, n: int, most_km: float = 2000.0) -> DataFrame:
    """First the nearest in each compass quadrant, then the next nearest, n in all within most_km. ranked is a short list."""
    near = ranked.filter(F.col("distance_km") <= most_km).withColumn("quadrant", F.floor(F.pmod(F.col("bearing_deg") + 45, F.lit(360.0)) / 90).cast("int"))
    near = near.withColumn("_q", F.row_number().over(Window.partitionBy("quadrant").orderBy("distance_km", "iaga_code")))
    order = Window.orderBy((F.col("_q") > 1).cast("int"), "distance_km", "iaga_code")
    return near.withColumn("pick", F.row_number().over(order)).filter(F.col("pick") <= n).drop("_q")


def base_from_observatories(series: DataFrame, stations: DataFrame, lat: float, lon: float, power: float = 2.0) -> DataFrame:
    """(minute, mag): inverse-distance mean, per minute, of the stations' deviations from their own means, plus the weighted
    mean of these means. Weights are those of the stations present in the minute."""
    km = F.greatest(haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")), F.lit(1.0))
    weights = stations.select("iaga_code", (1 / F.pow(km, power)).alias("w"))
    minutes = series.groupBy("iaga_code", F.floor(F.col("t") / 60).alias("minute")).agg(F.avg("mag").alias("mag"))
    means = minutes.groupBy("iaga_code").agg(F.avg("mag").alias("mean")).join(F.broadcast(weights), "iaga_code")
    level = means.agg((F.sum(F.col("w") * F.col("mean")) / F.sum("w")).alias("level"))
    out = minutes.join(F.broadcast(means), "iaga_code").groupBy("minute").agg((F.sum(F.col("w") * (F.col("mag") - F.col("mean"))) / F.sum("w")).alias("dev"))
    return out.crossJoin(F.broadcast(level)).select("minute", (F.col("level") + F.col("dev")).alias("mag"))


def bridged_minutes(series: DataFrame, most_gap: int = 5, key: str = "iaga_code") -> DataFrame:
    """(key, minute, t, mag): each station's means by minute, with gaps of up to most_gap minutes interpolated. A gap is filled
    from its two ends, so only neighbouring minutes meet."""
    minutes = series.groupBy(key, F.floor(F.col("t") / 60).alias("minute")).agg(F.avg("mag").alias("mag"))
    w = Window.partitionBy(key).orderBy("minute")
    ends = minutes.withColumn("_m", F.lead("minute").over(w)).withColumn("_v", F.lead("mag").over(w))
    upto = F.when((F.col("_m") - F.col("minute") - 1).between(1, most_gap), F.col("_m") - 1).otherwise(F.col("minute"))
    every = ends.withColumn("_at", F.explode(F.sequence("minute", upto)))
    share = (F.col("_at") - F.col("minute")) / F.nullif(F.col("_m") - F.col("minute"), F.lit(0))
    mag = F.when(F.col("_at") == F.col("minute"), F.col("mag")).otherwise(F.col("mag") + (F.col("_v") - F.col("mag")) * share)
    return every.select(key, F.col("_at").alias("minute"), (F.col("_at") * 60.0).alias("t"), mag.alias("mag"))


def base_series(raw: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """(kind, t, mag): the raw base series and, once there is one, the corrected one."""
    out = raw.select(F.lit("raw").alias("kind"), "t", "mag")
    return out if processed is None else out.unionByName(processed.select(F.lit("corrected").alias("kind"), "t", "mag"))


def with_neighbour_days(series: DataFrame, dates: DataFrame, good: float = 0.5) -> DataFrame:
    """(day, t, mag, substitute): the rows of the wanted days; a day with too few minutes takes the rows of the day before or
    after it, the better covered one, moved to it. dates: (day), days since 1970."""
    rows = series.withColumn("_day", F.floor(F.col("t") / 86400))
    cover = day_coverage(series).select(F.col("day").alias("_day"), "coverage")
    near = dates.select("day", F.explode(F.array(F.lit(0), F.lit(-1), F.lit(1))).alias("off")).withColumn("_day", F.col("day") + F.col("off")).join(cover, "_day", "left")
    own = F.max(F.when(F.col("off") == 0, F.coalesce("coverage", F.lit(0.0)))).over(Window.partitionBy("day"))
    rank = F.row_number().over(Window.partitionBy("day").orderBy(F.when(own >= good, F.abs("off")).otherwise(0), F.desc_nulls_last("coverage"), F.abs("off"), "off"))
    chosen = near.withColumn("_r", rank).filter("_r = 1").select("day", "_day", (F.col("off") != 0).alias("substitute"))
    return rows.join(F.broadcast(chosen), "_day").select("day", (F.col("t") + (F.col("day") - F.col("_day")) * 86400).alias("t"), "mag", "substitute")



def preview_series(series: DataFrame) -> DataFrame:
    """A row per station of what its series holds: minutes, span, range and the share of its days' minutes."""
    m = series.withColumn("_minute", F.floor(F.col("t") / 60)).withColumn("_day", F.floor(F.col("t") / 86400))
    got = m.groupBy("iaga_code").agg(F.count("*").alias("n"), F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.min("mag").alias("mag_min"), F.max("mag").alias("mag_max"), F.count_distinct("_minute").alias("_m"), F.count_distinct("_day").alias("n_days"))
    return got.withColumn("coverage", F.col("_m") / (1440.0 * F.col("n_days"))).drop("_m")


def substitute_base(series: DataFrame, code: str) -> DataFrame:
    """One station's series as a base: (t, mag), a row a time."""
    return series.filter(F.col("iaga_code") == code).groupBy("t").agg(F.min("mag").alias("mag"))
