"""Repairs of survey files as text rows (path, n, value), cell by cell: what isn't moved stays as it was, character by character."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTE, SEP = "'", ","


def column_number(letters: str) -> int:
    """0 for A, 25 for Z, 26 for AA."""
    out = 0
    for c in letters.strip().upper():
        if not "A" <= c <= "Z":
            raise ValueError(f"no column: {letters}")
        out = 26 * out + ord(c) - 64
    if not out:
        raise ValueError("no column")
    return out - 1


def cells(line: Column) -> Column:
    """The line's cells as they stand, quotes included; a separator between quotes doesn't count."""
    return F.split(line, SEP + "(?=(?:[^" + QUOTE + "]*" + QUOTE + "[^" + QUOTE + "]*" + QUOTE + ")*[^" + QUOTE + "]*$)")


def odd_quotes(line: Column) -> Column:
    return F.length(F.regexp_replace(line, "[^" + QUOTE + "]", "")) % 2 == 1


def move_back(rows: DataFrame, home: int, stray: int) -> DataFrame:
    """rows with `value` repaired and `fate`: where only the stray cell is filled, its text moves to its home cell.

    fate: blank, odd_quotes, too_short, both_filled, already_right, neither or moved; all but moved leave the line as it is."""
    c = cells(F.col("value"))
    got = rows.withColumn("_c", c)
    filled = lambda i: F.coalesce(F.trim(F.get("_c", F.lit(i))) != "", F.lit(False))
    fate = (
        F.when(F.trim("value") == "", "blank").when(odd_quotes(F.col("value")), "odd_quotes").when(F.size("_c") <= home, "too_short")
        .when(filled(home) & filled(stray), "both_filled").when(filled(home), "already_right").when(filled(stray), "moved").otherwise("neither")
    )
    moved = F.array_join(F.transform("_c", lambda x, i: F.when(i == home, F.get("_c", F.lit(stray))).when(i == stray, F.lit("")).otherwise(x)), SEP)
    return got.withColumn("fate", fate).withColumn("value", F.when(F.col("fate") == "moved", moved).otherwise(F.col("value"))).drop("_c")


def move_column(rows: DataFrame, name: str, after: str) -> DataFrame:
    """rows with the column `name` of each file put right after the column `after`; `moved` says which lines were.

    A file's first line that isn't blank names its columns. Files without both names, or in that order already, stay; so do lines of
    fewer cells than names. Cells beyond the names stay at the end."""
    plain = lambda x: F.trim(F.regexp_replace(x, QUOTE, ""))
    heads = rows.filter(F.trim("value") != "").groupBy("path").agg(F.min_by("value", "n").alias("_head"))
    heads = heads.withColumn("_names", F.transform(cells(F.col("_head")), plain))
    heads = heads.select("path", F.size("_names").alias("_size"), (F.array_position("_names", name) - 1).cast("int").alias("_from"), (F.array_position("_names", after) - 1).cast("int").alias("_after"))
    got = rows.join(F.broadcast(heads), "path", "left").withColumn("_c", cells(F.col("value")))
    fit = (F.col("_from") >= 0) & (F.col("_after") >= 0) & (F.col("_from") != F.col("_after") + 1) & (F.col("_from") != F.col("_after")) & (F.size("_c") >= F.col("_size")) & (F.trim("value") != "")
    rest = F.filter(F.transform("_c", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda e: e["i"] != F.col("_from"))
    placed = F.flatten(F.transform(rest, lambda e: F.when(e["i"] == F.col("_after"), F.array(e["x"], F.get("_c", F.col("_from")))).otherwise(F.array(e["x"]))))
    out = got.withColumn("moved", F.coalesce(fit, F.lit(False)))
    return out.withColumn("value", F.when(F.col("moved"), F.array_join(placed, SEP)).otherwise(F.col("value"))).select("path", "n", "value", "moved")


def inventory(points: DataFrame, shift_hours: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(a row per file, a row per file and day) of points (path, timestamp, lat, lon), days in shifted time."""
    at = F.timestamp_micros((F.unix_micros("timestamp") + int(shift_hours * 3_600_000_000)).cast("long"))
    p = points.withColumn("at", at).withColumn("day", F.to_date("at"))
    files = p.groupBy("path").agg(
        F.count("at").alias("n_points"), F.sum(F.col("at").isNull().cast("long")).alias("n_untimed"), F.min("at").alias("first"), F.max("at").alias("last"),
        F.round((F.unix_micros(F.max("at")) - F.unix_micros(F.min("at"))) / 6e7, 1).alias("minutes"), F.count_distinct("day").alias("n_days"), F.array_join(F.array_sort(F.collect_set(F.col("day").cast("string"))), ", ").alias("days"),
        F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"),
    )
    days = p.filter("at is not null").groupBy("path", "day").agg(F.count("*").alias("n_points"), F.min("at").alias("first"), F.max("at").alias("last"))
    return files.withColumn("past_midnight", F.col("n_days") > 1), days
