"""Summaries and quality verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def basic_stats(df: DataFrame, value: str, keys=()) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))


def robust_scale(df: DataFrame, value: str) -> DataFrame:
    """One row (center, scale): median and scaled MAD; the standard deviation where the MAD is 0."""
    m = df.agg(F.median(value).alias("center"), F.stddev_samp(value).alias("_sd"))
    out = df.crossJoin(F.broadcast(m)).agg(F.max("center").alias("center"), F.max("_sd").alias("_sd"), (1.4826 * F.median(F.abs(F.col(value) - F.col("center")))).alias("scale"))
    return out.select("center", F.when(F.col("scale") > 0, F.col("scale")).otherwise(F.col("_sd")).alias("scale"))


def extrema(grid: DataFrame) -> DataFrame:
    """(kind, row, col, easting, northing, value) of the largest and smallest cell; the first in row-major order wins ties."""
    cell = F.struct("row", "col", "easting", "northing", "value")
    known = grid.filter(F.col("value").isNotNull())
    got = known.agg(F.min_by(cell, F.struct(-F.col("value"), "row", "col")).alias("max"), F.min_by(cell, F.struct("value", "row", "col")).alias("min"))
    return got.select(F.explode(F.create_map(F.lit("max"), F.col("max"), F.lit("min"), F.col("min")))).select(F.col("key").alias("kind"), "value.*")


def survey_summary(points: DataFrame) -> DataFrame:
    """One row: points, files, lines, time span, share excluded."""
    kept = (F.col("line_id") >= 0).cast("double")
    return points.agg(F.count("*").alias("n_points"), F.count_distinct("source_file_index").alias("n_files"), F.count_distinct(F.when(F.col("line_id") >= 0, F.col("line_id"))).alias("n_lines"), F.min("t").alias("t_start"), F.max("t").alias("t_end"), ((1 - F.avg(kept)) * 100).alias("excluded_pct"))


def base_summary(base: DataFrame, t: str = "t", mag: str = "mag") -> DataFrame:
    """One row: rows, time span, range of the field, rows that repeat a time."""
    return base.agg(F.count("*").alias("n_points"), F.min(t).alias("t_start"), F.max(t).alias("t_end"), F.min(mag).alias("mag_min"), F.max(mag).alias("mag_max"), (F.count(t) - F.count_distinct(t)).alias("n_repeated"))


def exclusion_counts(points: DataFrame) -> DataFrame:
    """(reason, n, pct): rows by the reason that they are on no line; lines' own rows are `kept`."""
    why = F.when(F.col("line_id") >= 0, "kept").otherwise(F.coalesce("reason", F.lit("other")))
    total = points.agg(F.count("*").alias("_t"))
    return points.groupBy(why.alias("reason")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("reason", "n", (100.0 * F.col("n") / F.col("_t")).alias("pct"))


def grid_overlay(grid: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """One row of what stands beside a grid on a map: cells, share without data, range, mean, deviation and the ends of the stretch."""
    v = F.col("value")
    return grid.agg(F.count("*").alias("n_cells"), (100.0 * (1 - F.count(v) / F.count("*"))).alias("gap_pct"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.percentile(v, low).alias("low"), F.percentile(v, high).alias("high"))


def line_profile(points: DataFrame, line_id: int, value: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("line_id").orderBy("t", "point_id")
    step = F.coalesce(F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2)), F.lit(0.0))
    return points.filter(F.col("line_id") == line_id).withColumn("_d", step).select("point_id", F.sum("_d").over(w).alias("distance_m"), F.col(value).alias("value"))


#: Criterion -> (input, largest value that passes).
CRITERIA = {"repeatability": ("sigma_nt", 5.0), "sampling_gaps": ("gap_pct", 5.0), "excluded": ("excluded_pct", 30.0), "noise": ("noise_ratio", 2.0), "diurnal_cover": ("uncovered_pct", 0.0), "heading": ("heading_nt", 5.0)}


def certificate(figures: dict[str, float | None]) -> dict:
    """pass, fail or not_evaluated for each criterion; overall is fail if any fails, not_evaluated if none could be."""
    verdicts = {}
    for name, (key, most) in CRITERIA.items():
        v = figures.get(key)
        verdicts[name] = "not_evaluated" if v is None else "pass" if v <= most else "fail"
    seen = set(verdicts.values())
    return {"criteria": verdicts, "overall": "fail" if "fail" in seen else "pass" if "pass" in seen else "not_evaluated"}


LEAST_KNOWN = 400


def continuation_report(grid: DataFrame) -> DataFrame:
    """One row: whether gaps of a grid (all cells of a rectangle) can be filled by a source layer, and how many there are."""
    known, every = F.count("value"), F.count("*")
    out = grid.agg(known.alias("n_known"), (every - known).alias("n_gaps"), (100.0 * (every - known) / every).alias("gap_pct"))
    reason = F.when(F.col("n_known") < LEAST_KNOWN, "too few known cells").when(F.col("n_gaps") == 0, "no gaps")
    return out.withColumn("reason", reason).withColumn("applicable", F.col("reason").isNull())


def latitude_warning(inclination: float, least: float = 30.0) -> str | None:
    """Reduction to the pole stretches noise along the declination where the field is flat."""
    return f"the field's inclination is {inclination:.0f} degrees; below {least:.0f} reduce to the equator" if abs(inclination) < least else None


def places(found: DataFrame, lat, lon) -> DataFrame:
    """extrema's rows with their place in degrees."""
    return found.withColumn("lat", lat).withColumn("lon", lon)


def verdicts(figures: DataFrame) -> DataFrame:
    """figures (a row a survey, a column an input of CRITERIA) with a verdict per criterion and `overall`, by certificate's rules."""
    out, names = figures, list(CRITERIA)
    for name, (key, most) in CRITERIA.items():
        v = F.col(key) if key in figures.columns else F.lit(None).cast("double")
        out = out.withColumn(name, F.when(v.isNull(), "not_evaluated").when(v <= most, "pass").otherwise("fail"))
    every = F.array(*names)
    return out.withColumn("overall", F.when(F.array_contains(every, "fail"), "fail").when(F.array_contains(every, "pass"), "pass").otherwise("not_evaluated"))
