"""The whole way from loaded points to a processed survey: clock lag, diurnal correction, spikes, lines, reference field, levelling.

Each step can be left out; what it is told stands in one checked table of settings, and what it did is returned beside the points."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import leveling, lines, series, stats, timejoin
from .shared import written


def bounded(default, low=None, high=None, above=None):
    """A setting with its bounds: low <= value <= high, value > above."""
    return field(default=default, metadata={"low": low, "high": high, "above": above})


@dataclass(frozen=True)
class Settings:
    lag_s: float = bounded(0.0, -10, 10)
    diurnal: bool = True
    base_offset_s: float = bounded(0.0, -86400, 86400)
    reference: str | float = "mean"
    despike: bool = True
    despike_rows: int = bounded(11, 3, 501)
    despike_k: float = bounded(4.0, above=0)
    lag_seconds: float = bounded(1.0, above=0)
    least_speed: float = bounded(1.5, 0)
    tolerance_deg: float = bounded(20.0, 1, 90)
    most_gap_s: float = bounded(1.0, above=0)
    least_length_m: float = bounded(150.0, 0)
    trim_m: float = bounded(15.0, 0)
    level: bool = False
    level_window: int = bounded(9, 3, 99)

    def __post_init__(self) -> None:
        for f in fields(self):
            v, m = getattr(self, f.name), f.metadata
            if not m or isinstance(v, bool):
                continue
            low, high, above = m["low"], m["high"], m["above"]
            if (low is not None and v < low) or (high is not None and v > high) or (above is not None and v <= above):
                raise ValueError(f"{f.name} = {v} is out of bounds")

    def rules(self) -> lines.LineRules:
        return lines.LineRules(self.lag_seconds, self.least_speed, self.tolerance_deg, self.most_gap_s, self.least_length_m, self.trim_m)


def process(points: DataFrame, base: DataFrame | None = None, settings: Settings = Settings(), regional: DataFrame | None = None) -> DataFrame:
    """points (point_id, t, x, y, source_file_index, mag_raw) with mag_diurnal_corrected, mag_filtered, line_id, tie_line_id, reason, heading_deg,
    speed_mps, anomaly and tmi.

    base: (t, mag); without it, or with diurnal off, the field stays uncorrected. regional: (point_id, regional) is the reference field
    that the anomaly is taken from; without it, its median. tmi is the anomaly on the survey's level again, levelled if wanted.
    """
    df = timejoin.apply_gps_lag(points, settings.lag_s) if settings.lag_s else points
    if base is not None and settings.diurnal:
        df = timejoin.diurnal_correction(df, base, offset_s=settings.base_offset_s, reference=settings.reference).withColumnRenamed("corrected", "mag_diurnal_corrected").drop("base_mag")
    else:
        df = df.withColumn("mag_diurnal_corrected", F.col("mag_raw").cast("double"))
    if settings.despike:
        df = series.despike(df, "mag_diurnal_corrected", ["source_file_index"], ["t", "point_id"], settings.despike_rows, settings.despike_k).withColumnRenamed("despiked", "mag_filtered").drop("is_spike")
    else:
        df = df.withColumn("mag_filtered", F.col("mag_diurnal_corrected"))
    df = written(lines.detect_lines(df, settings.rules()), "processed")
    if regional is not None:
        df = df.join(regional.select("point_id", F.col("regional").alias("_field")), "point_id", "left")
    else:
        df = df.crossJoin(F.broadcast(df.agg(F.median("mag_filtered").alias("_field"))))
    df = df.withColumn("anomaly", F.col("mag_filtered") - F.col("_field"))
    if settings.level:
        kept = df.filter("line_id >= 0")
        azimuth = df.select("azimuth_deg").first()
        gap = series.line_spacing(kept, "line_id", leveling.across_track(F.col("x"), F.col("y"), F.col("azimuth_deg"))).first()
        if azimuth and gap.spacing_m:
            shifts = leveling.statistical_shifts(kept, "anomaly", azimuth.azimuth_deg, gap.spacing_m, settings.level_window)
            df = leveling.apply_shifts(df, shifts, "anomaly").withColumn("anomaly", F.col("leveled")).drop("leveled")
    return df.withColumn("tmi", F.col("anomaly") + F.col("_field")).drop("_field", "true_deg", "azimuth_deg")


def report(processed: DataFrame, base: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables that tell what a processed survey holds: counts, reasons, lines, statistics of the field and, with a base, its cover."""
    out = {
        "survey": stats.survey_summary(processed), "reasons": stats.exclusion_counts(processed), "lines": lines.line_summary(processed),
        "field": stats.basic_stats(processed, "tmi"), "noise": series.difference_qc(processed.filter("line_id >= 0"), "mag_filtered", "line_id", ["t", "point_id"]),
    }
    return out | ({"cover": timejoin.diurnal_coverage(processed, base)} if base is not None else {})
