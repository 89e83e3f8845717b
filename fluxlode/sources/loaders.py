"""Survey and base-station files as tables. Every reader takes text rows (path, n, value), so files are parsed in parallel and a file that
doesn't fit its format leaves no rows instead of failing the rest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import written

MISSING = 90_000.0


def text_rows(spark: SparkSession, paths) -> DataFrame:
    """(path, n, value): the lines of files, numbered from 0 in each, without a byte-order mark. A file is read whole, as one row, and split."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace(F.col("value"), "^﻿", "").alias("text"))
    return files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("n", "value")).filter("value <> ''")


def detect_format(text: Column) -> Column:
    """Format of a survey file by what its first 4,000 characters hold."""
    head = F.substring(text, 1, 4000)
    return (
        F.when(head.rlike(r"Timestamp \[ms\]\s*;"), "sensys_r3_raw")
        .when(head.rlike(r"timestamp_ms\s+sensor_id"), "sensys_r3_asc")
        .when(head.contains("MagField_J1"), "microinfinity")
        .when(head.contains("Next WP") & head.contains("TMI"), "sensys_r1")
        .otherwise("generic")
    )


def detect_base_format(first_line: Column) -> Column:
    return F.when(first_line.rlike("오전|오후"), "korean_ampm").when(F.lower(first_line).rlike("timestamp.*mag"), "timestamp_mag").when(first_line.rlike(r"^\s*\d{1,2}\s+\d{1,2}\s+\d{1,2}(\s+-?[\d.]+){4}\s*$"), "hms_xyzf")


def table_rows(rows: DataFrame, header: Column, sep: str, quote: str = "") -> DataFrame:
    """(path, n, cells): a map of column name to trimmed text for each line below its file's first line that is a header. Names of one file are one row."""
    strip = lambda c: F.trim(F.regexp_replace(c, f"^\\s*{quote}|{quote}\\s*$", "")) if quote else F.trim(c)
    cut = F.transform(F.split(F.trim("value"), sep), strip)
    heads = rows.filter(header).groupBy("path").agg(F.min_by(F.struct(F.col("n").alias("at"), cut.alias("names")), "n").alias("h"))
    out = rows.join(F.broadcast(heads), "path").filter(F.col("n") > F.col("h.at")).withColumn("v", cut)
    size = F.least(F.size("h.names"), F.size("v"))
    return out.select("path", "n", F.map_from_arrays(F.slice("h.names", 1, size), F.slice("v", 1, size)).alias("cells"))


def cell(*names: str) -> Column:
    """First of the named cells that is there; empty ones count as missing."""
    return F.coalesce(*[F.nullif(F.try_element_at("cells", F.lit(n)), F.lit("")) for n in names])


def number(*names: str) -> Column:
    return cell(*names).try_cast("double")


def moment(text: Column, *formats: str) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats], text.try_cast("timestamp"))


CLOCK = ("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS][.SS][.S]", "yyyy/MM/dd HH:mm:ss[.SSSSSS][.SSS][.SS][.S]", "dd.MM.yyyy HH:mm:ss[.SSS][.SS][.S]")
POINT = ["path", "n", "timestamp", "lat", "lon", "mag_raw", "altitude_msl_m", "geoid_separation_m", "speed_over_ground", "gyro_mag", "accel_horiz_g", "compass_x", "compass_y", "compass_z", "used_precompensated_mag"]


def _point(rows: DataFrame, **columns: Column) -> DataFrame:
    texts = {"timestamp": "timestamp", "used_precompensated_mag": "boolean"}
    return rows.select("path", "n", *[columns.get(c, F.lit(None)).cast(texts.get(c, "double")).alias(c) for c in POINT[2:]])


def generic(rows: DataFrame) -> DataFrame:
    """Comma-separated, quote '; MagComp is taken instead of Mag in files that have it; rows of MagValid 0 go."""
    t = table_rows(rows, F.col("value").rlike(r"(?i)\bDate\b.*\bTime\b"), ",", "'")
    has = t.groupBy("path").agg(F.max(number("MagComp").isNotNull()).alias("comp"))
    t = t.join(F.broadcast(has), "path").filter(F.coalesce(number("MagValid") != 0, F.lit(True)))
    axes = lambda p, last: [number(f"{p}{a}") for a in ("XYZ" if last else "XY")]
    size = lambda cs: F.sqrt(sum(c * c for c in cs))
    return _point(
        t, timestamp=moment(F.concat_ws(" ", cell("Date"), cell("Time")), *CLOCK), lat=number("Latitude"), lon=number("Longitude"), mag_raw=F.when(F.col("comp"), number("MagComp")).otherwise(number("Mag")),
        altitude_msl_m=number("Altitude"), geoid_separation_m=number("HeightOverEllipsoid") - number("Altitude"), speed_over_ground=number("SpeedOverGround"), gyro_mag=size(axes("Gyroscope", True)),
        accel_horiz_g=size(axes("Accelerometer", False)), compass_x=number("CompassX"), compass_y=number("CompassY"), compass_z=number("CompassZ"), used_precompensated_mag=F.col("comp"),
    )


def sensys_r1(rows: DataFrame) -> DataFrame:
    t = table_rows(rows, F.col("value").contains("Next WP"), ",")
    return _point(t, timestamp=moment(F.concat_ws(" ", cell("Date"), cell("Time")), *CLOCK), lat=number("Latitude"), lon=number("Longitude"), mag_raw=number("TMI"), altitude_msl_m=number("Altitude"), compass_x=number("Bx"), compass_y=number("By"), compass_z=number("Bz"))


def microinfinity(rows: DataFrame, day: str) -> DataFrame:
    """Values in microtesla; the file has seconds of the week only, so the day they start from is given."""
    t = table_rows(rows, F.col("value").contains("MagField_J1"), ",")
    at = F.timestamp_micros((F.unix_micros(F.lit(day).cast("timestamp")) + number("TOW") * 1_000_000).cast("long"))
    return _point(t, timestamp=at, lat=number("lat[deg]"), lon=number("lon[deg]"), mag_raw=1000 * number("MagField_J1[uT]"), altitude_msl_m=number("alt[m]"))


def sensys_r3_raw(rows: DataFrame) -> DataFrame:
    """Semicolon rows below a block with Date and Time; the field is the size of B1; fixes of (0, 0) are interpolated along the rows."""
    grab = lambda p: F.max(F.nullif(F.regexp_extract("value", p, 1), F.lit("")))
    start = rows.groupBy("path").agg(grab(r"^Date:\s*(\d{2}\.\d{2}\.\d{4})").alias("_d"), grab(r"^Time:\s*(\d{2}:\d{2}:\d{2})").alias("_t"))
    t = table_rows(rows, F.col("value").rlike(r"^Timestamp \[ms\]"), ";").join(F.broadcast(start), "path")
    t = t.withColumn("cells", F.map_from_entries(F.transform(F.map_entries("cells"), lambda e: F.struct(F.trim(F.regexp_replace(e["key"], r"\s*\[.*\]", "")).alias("key"), e["value"].alias("value")))))
    base = F.unix_micros(F.try_to_timestamp(F.concat_ws(" ", "_d", "_t"), F.lit("dd.MM.yyyy HH:mm:ss")))
    fix = (number("Latitude") != 0) | (number("Longitude") != 0)
    out = _point(
        t, timestamp=F.timestamp_micros((base + number("Timestamp") * 1000).cast("long")), lat=F.when(fix, number("Latitude")), lon=F.when(fix, number("Longitude")),
        mag_raw=F.sqrt(sum(number(f"B1{a}") ** 2 for a in "xyz")), altitude_msl_m=F.when(fix, number("Altitude")), compass_x=number("B1x"), compass_y=number("B1y"), compass_z=number("B1z"),
    )
    return interpolate_rows(out, ["lat", "lon", "altitude_msl_m"], inside=True)


def sensys_r3_asc(rows: DataFrame) -> DataFrame:
    """White-space table of several sensors; only the first sensor of a file is kept."""
    t = table_rows(rows, F.col("value").rlike(r"timestamp_ms\s+sensor_id"), r"\s+")
    first = t.groupBy("path").agg(F.min_by(cell("sensor_id"), "n").alias("_s"))
    t = t.join(F.broadcast(first), "path").filter(cell("sensor_id") == F.col("_s"))
    return _point(t, timestamp=F.timestamp_micros((number("timestamp_ms") * 1000).cast("long")), lat=number("lat"), lon=number("lon"), mag_raw=number("total_field_nt"), compass_x=number("mag_x_nt"), compass_y=number("mag_y_nt"), compass_z=number("mag_z_nt"))


def interpolate_rows(df: DataFrame, columns: list[str], inside: bool = False) -> DataFrame:
    """Fills nulls of a file linearly by row number; beyond the known rows the end's value, or null if only `inside`."""
    whole = (Window.unboundedPreceding, 0)
    before, after = (Window.partitionBy("path").orderBy(o).rowsBetween(*whole) for o in (F.col("n"), F.desc("n")))
    for c in columns:
        known = F.when(F.col(c).isNotNull(), F.struct("n", F.col(c).alias("v")))
        df = df.withColumn("_p", F.last(known, True).over(before)).withColumn("_q", F.last(known, True).over(after))
        line = F.col("_p.v") + (F.col("_q.v") - F.col("_p.v")) * (F.col("n") - F.col("_p.n")) / F.nullif(F.col("_q.n") - F.col("_p.n"), F.lit(0))
        df = df.withColumn(c, F.coalesce(F.col(c), line, *([] if inside else [F.col("_p.v"), F.col("_q.v")]))).drop("_p", "_q")
    return df


def finalize(df: DataFrame) -> DataFrame:
    """Rows with a time, place and value; places out of range or at (0, 0) go; gaps of height and speed are filled; ellipsoidal height is added."""
    ok = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & ~((F.col("lat") == 0) & (F.col("lon") == 0))
    df = df.filter(F.col("timestamp").isNotNull() & F.col("mag_raw").isNotNull() & ~F.isnan("mag_raw") & ok)
    df = interpolate_rows(df, ["altitude_msl_m", "geoid_separation_m", "speed_over_ground"])
    return df.withColumn("altitude_ellipsoidal_m", F.col("altitude_msl_m") + F.coalesce("geoid_separation_m", F.lit(0.0)))


def load_survey(spark: SparkSession, paths, day: str = "1970-01-01") -> DataFrame:
    """Survey points of files of any known format: source_file_index by path, one row a time (the first), point_id by time.

    point_id is the rank in the whole order, counted range by range (see series.global_index)."""
    from ..operators.series import global_index

    rows = written(text_rows(spark, paths), "lines")
    kinds = written(file_formats(rows), "formats")
    files = kinds.select("path", (F.row_number().over(Window.orderBy("path")) - 1).alias("source_file_index"))  # a row per file
    return number_points(finalize(parsed(rows, kinds, day)).join(F.broadcast(files), "path"), global_index)


def file_formats(rows: DataFrame) -> DataFrame:
    """(path, kind) by the first hundred lines of each file."""
    head = F.array_sort(F.collect_list(F.struct("n", "value")))
    return rows.filter("n < 100").groupBy("path").agg(detect_format(F.concat_ws("\n", F.transform(head, lambda r: r["value"]))).alias("kind"))


def parsed(rows: DataFrame, kinds: DataFrame, day: str) -> DataFrame:
    """Points of all files; a format that no file has is not looked for."""
    readers = {"generic": generic, "sensys_r1": sensys_r1, "microinfinity": lambda r: microinfinity(r, day), "sensys_r3_raw": sensys_r3_raw, "sensys_r3_asc": sensys_r3_asc}
    have = [r.kind for r in kinds.select("kind").distinct().orderBy("kind").collect()] or ["generic"]
    rows = rows.join(F.broadcast(kinds), "path")
    return reduce(DataFrame.unionByName, [readers[k](rows.filter(F.col("kind") == k).select("path", "n", "value")) for k in have])


def number_points(df: DataFrame, index) -> DataFrame:
    """The first row of each time (by file, then line), numbered by time from 0."""
    first = df.withColumn("_r", F.row_number().over(Window.partitionBy("timestamp").orderBy("source_file_index", "n"))).filter("_r = 1").drop("_r")
    return index(first, ["timestamp"], "point_id").drop("path", "n")


def korean_ampm(rows: DataFrame) -> DataFrame:
    """No header; the second cell is the value, the fourth a 12-hour time, the fifth month/day/year."""
    c = F.split("value", ",")
    got = rows.select("path", "n", F.trim(F.get(c, F.lit(1))).try_cast("double").alias("mag"), F.get(c, F.lit(3)).alias("_t"), F.trim(F.get(c, F.lit(4))).alias("_d"))
    part = lambda i: F.regexp_extract("_t", r"(\d{1,2}):(\d{2}):(\d{2})", i).try_cast("int")
    hour = part(1) % 12 + F.when(F.col("_t").contains("오후"), 12).otherwise(0)
    day = F.unix_micros(F.try_to_timestamp("_d", F.lit("MM/dd/yy")))
    return got.select("path", "n", F.timestamp_micros(day + (hour * 3600 + part(2) * 60 + part(3)).cast("long") * 1_000_000).alias("timestamp"), "mag")


def timestamp_mag(rows: DataFrame) -> DataFrame:
    low = rows.withColumn("value", F.when(F.lower("value").rlike("timestamp.*mag"), F.lower("value")).otherwise(F.col("value")))
    t = table_rows(low, F.col("value").rlike("timestamp.*mag"), ",")
    return t.select("path", "n", moment(cell("timestamp"), *CLOCK).alias("timestamp"), number("mag_nt", "mag").alias("mag"))


def hms_xyzf(rows: DataFrame, day: str) -> DataFrame:
    """HH MM SS X Y Z F; the date is in the file's name as 20YYMMDD, else the given day, which is flagged."""
    c = F.split(F.trim("value"), r"\s+")
    named = F.try_to_timestamp(F.nullif(F.regexp_extract("path", r"(20\d{6})[^/]*$", 1), F.lit("")), F.lit("yyyyMMdd"))
    base = F.unix_micros(F.coalesce(named, F.lit(day).cast("timestamp")))
    part = lambda i: F.get(c, F.lit(i)).try_cast("long")
    return rows.filter(F.size(c) >= 7).select("path", "n", F.timestamp_micros(base + (part(0) * 3600 + part(1) * 60 + part(2)) * 1_000_000).alias("timestamp"), F.get(c, F.lit(6)).try_cast("double").alias("mag"), named.isNull().alias("date_assumed"))


def load_base(spark: SparkSession, paths, day: str = "1970-01-01") -> DataFrame:
    """(timestamp, mag, date_assumed) of base-station files of any known format, one row a time (the first by path)."""
    rows = written(text_rows(spark, paths), "lines")
    kinds = rows.groupBy("path").agg(detect_base_format(F.min_by("value", "n")).alias("kind"))
    rows = rows.join(F.broadcast(kinds), "path")
    every = korean_ampm(rows.filter("kind = 'korean_ampm'")).unionByName(timestamp_mag(rows.filter("kind = 'timestamp_mag'"))).withColumn("date_assumed", F.lit(False)).unionByName(hms_xyzf(rows.filter("kind = 'hms_xyzf'"), day))
    every = every.filter("timestamp is not null and mag is not null")
    return every.groupBy("timestamp").agg(F.min_by(F.struct("mag", "date_assumed"), F.struct("path", "n")).alias("b")).select("timestamp", "b.mag", "b.date_assumed")


def load_iaga(spark: SparkSession, paths) -> DataFrame:
    """(iaga_code, station_name, lat, lon, elevation_m, reported, timestamp, mag) of IAGA-2002 files. Values from 90,000 up are missing; mag is F, else the size
    of X, Y, Z, else of H, Z; longitudes over 180 are west."""
    return iaga(written(text_rows(spark, paths), "lines"))


def iaga(rows: DataFrame) -> DataFrame:
    """load_iaga's rows of text lines."""
    label = lambda name: F.max(F.when(F.substring("value", 2, 23).startswith(name), F.trim(F.substring("value", 25, 45))))
    head = rows.groupBy("path").agg(*[label(n).alias(a) for n, a in (("IAGA CODE", "iaga_code"), ("Station Name", "station_name"), ("Geodetic Latitude", "_lat"), ("Geodetic Longitude", "_lon"), ("Elevation", "_el"), ("Reported", "reported"))], F.max(F.when(F.col("value").startswith("DATE"), F.split(F.trim(F.regexp_replace("value", r"\|", " ")), r"\s+"))).alias("_names"))
    data = rows.filter(F.col("value").rlike(r"^\d{4}-\d{2}-\d{2} ")).join(F.broadcast(head), "path").withColumn("_v", F.split(F.trim("value"), r"\s+"))
    at = lambda c: F.get("_v", (F.array_position(F.transform("_names", lambda n: F.when(F.length(n) == 4, F.right(n, F.lit(1))).otherwise(n)), c) - 1).cast("int"))
    got = lambda c: F.when(F.array_position(F.transform("_names", lambda n: F.when(F.length(n) == 4, F.right(n, F.lit(1))).otherwise(n)), c) > 3, F.when(at(c).try_cast("double") < MISSING, at(c).try_cast("double")))
    mag = F.coalesce(got("F"), F.sqrt(got("X") ** 2 + got("Y") ** 2 + got("Z") ** 2), F.sqrt(got("H") ** 2 + got("Z") ** 2))
    lon = F.col("_lon").try_cast("double")
    when = F.try_to_timestamp(F.concat_ws(" ", F.get("_v", F.lit(0)), F.get("_v", F.lit(1))), F.lit("yyyy-MM-dd HH:mm:ss[.SSS]"))
    return data.select("iaga_code", "station_name", F.col("_lat").try_cast("double").alias("lat"), F.when(lon > 180, lon - 360).otherwise(lon).alias("lon"), F.col("_el").try_cast("double").alias("elevation_m"), "reported", when.alias("timestamp"), mag.alias("mag"))
