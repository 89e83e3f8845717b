"""Survey lines as gaps and islands: detection, bridging, ties, turns and the lines' own figures.

Rows: point_id, t (seconds), x, y, source_file_index. Windows are partitioned by file, so files run in parallel. Where a step's
rows meet a figure of their own, the rows are written first, so no step reads the files again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import across_track, axial_difference
from ..shared import written


@dataclass(frozen=True)
class LineRules:
    lag_seconds: float = 1.0
    least_speed: float = 1.5
    tolerance_deg: float = 20.0
    most_gap_s: float = 1.0
    least_length_m: float = 150.0
    trim_m: float = 15.0
    bridge_m: float = 100.0
    bridge_across_m: float = 15.0
    bridge_ratio: float = 2.0


FILE = ["source_file_index"]


def by_time():
    return Window.partitionBy(*FILE).orderBy("t", "point_id")


def headings(df: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Adds speed_mps, heading_deg (undirected, 0..180) and true_deg by central differences over about lag_seconds.

    The lag is a file's own number of rows; files have few different ones, which are the cases of one expression."""
    w = by_time()
    step = df.select(*FILE, (F.col("t") - F.lag("t").over(w)).alias("d")).filter("d > 0").groupBy(*FILE).agg(F.median("d").alias("_d"))
    found = step.select(*FILE, F.greatest(F.lit(1), F.bround(F.lit(rules.lag_seconds) / F.col("_d")).cast("int")).alias("_lag")).collect()  # a row a file
    sizes = sorted({1, *(r._lag for r in found)})
    lags = df.sparkSession.createDataFrame([tuple(r) for r in found], step.select(*FILE).schema.add("_lag", "integer"))
    df = df.join(F.broadcast(lags), FILE, "left").withColumn("_lag", F.coalesce("_lag", F.lit(1)))
    place = F.struct("t", "x", "y")
    at = lambda move: F.coalesce(*[F.when(F.col("_lag") == n, move(place, n).over(w)) for n in sizes])
    df = df.withColumn("_b", at(F.lag)).withColumn("_a", at(F.lead))
    dx, dy, dt = F.col("_a.x") - F.col("_b.x"), F.col("_a.y") - F.col("_b.y"), F.col("_a.t") - F.col("_b.t")
    df = df.withColumn("speed_mps", F.when(dt > 0, F.sqrt(dx * dx + dy * dy) / dt)).withColumn("true_deg", F.when(dt > 0, F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0))))
    return df.withColumn("heading_deg", F.pmod(F.col("true_deg"), F.lit(180.0))).drop("_lag", "_b", "_a")


def dominant_azimuth(df: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """One row, azimuth_deg: the middle of the fullest two-degree bin of the valid headings, the first of equal ones;
    with fewer than ten of them the median heading."""
    valid = df.filter(F.col("heading_deg").isNotNull() & (F.col("speed_mps") >= rules.least_speed))
    bins = valid.groupBy(F.least(F.floor(F.col("heading_deg") / 2), F.lit(89)).alias("b")).agg(F.count("*").alias("n"))
    best = bins.agg(F.max_by(F.col("b") * 2 + 1.0, F.struct("n", -F.col("b"))).alias("mode"), F.sum("n").alias("n"))
    plain = df.agg(F.median("heading_deg").alias("m"))
    return best.crossJoin(plain).select(F.when(F.col("n") >= 10, F.col("mode")).otherwise(F.col("m")).alias("azimuth_deg"))


def principal_azimuth(df: DataFrame, keys=()) -> DataFrame:
    """azimuth_deg of the longest axis of each group's points, from their covariance."""
    return df.groupBy(*keys).agg(F.pmod(F.degrees(0.5 * F.atan2(2 * F.covar_samp("x", "y"), F.var_samp("x") - F.var_samp("y"))), F.lit(180.0)).alias("azimuth_deg"))


def islands(df: DataFrame, on: Column, name: str, most_gap_s: float) -> DataFrame:
    """Adds `name`, the number of the run of rows that share `on`; a run ends where `on` changes or time jumps."""
    df = df.withColumn("_on", F.coalesce(on, F.lit(False)))
    cut = F.coalesce((F.col("_on") != F.lag("_on").over(by_time())) | (F.col("t") - F.lag("t").over(by_time()) > most_gap_s), F.lit(True))
    return df.withColumn("_cut", cut.cast("int")).withColumn(name, F.sum("_cut").over(by_time())).drop("_cut")


def group_lines(df: DataFrame, on: Column, rules: LineRules = LineRules(), start_id: int = 0) -> DataFrame:
    """Adds line_id (-1: none) and reason. Runs of `on` shorter than least_length_m are short_line; trim_m at both ends
    of the others is turn_buffer; a run that has nothing left is short_line. Ids count the runs that are left, by time."""
    df = islands(df, on, "_run", rules.most_gap_s)
    run = Window.partitionBy(*FILE, "_run").orderBy("t", "point_id")
    step = F.coalesce(F.sqrt(F.pow(F.col("x") - F.lag("x").over(run), 2) + F.pow(F.col("y") - F.lag("y").over(run), 2)), F.lit(0.0))
    df = df.withColumn("_step", step).withColumn("_s", F.sum("_step").over(run))
    whole = Window.partitionBy(*FILE, "_run")
    df = df.withColumn("_len", F.max("_s").over(whole)).withColumn("_t0", F.min("t").over(whole))
    long = F.col("_on") & (F.col("_len") >= rules.least_length_m)
    df = df.withColumn("_keep", long & F.col("_s").between(rules.trim_m, F.col("_len") - rules.trim_m))
    df = written(df.withColumn("_any", F.max(F.col("_keep").cast("int")).over(whole)), "runs")
    runs = df.filter("_keep").groupBy(*FILE, "_run").agg(F.min("_t0").alias("_first"))
    # a row per run, far fewer than points, is numbered in one window
    ids = runs.withColumn("_id", F.row_number().over(Window.orderBy("_first", *FILE, "_run")) - 1 + start_id).drop("_first")
    df = df.join(F.broadcast(ids), [*FILE, "_run"], "left")
    reason = F.when(~F.col("_on"), None).when(~long | (F.col("_any") == 0), "short_line").when(~F.col("_keep"), "turn_buffer")
    out = df.withColumn("line_id", F.when(F.col("_keep"), F.col("_id")).otherwise(-1).cast("int")).withColumn("reason", reason)
    return out.drop("_run", "_step", "_s", "_len", "_t0", "_keep", "_any", "_id", "_on")


def bridge_gaps(df: DataFrame, azimuth: Column, rules: LineRules = LineRules()) -> DataFrame:
    """Joins neighbouring lines of a file across a short gap that keeps to the line: the rows between get the first
    line's id, and so does the second. Whether a gap is bridged depends on its two ends only."""
    df = df.withColumn("_i", F.row_number().over(by_time())).withColumn("_c", across_track(F.col("x"), F.col("y"), azimuth))
    step = F.coalesce(F.sqrt(F.pow(F.col("x") - F.lag("x").over(by_time()), 2) + F.pow(F.col("y") - F.lag("y").over(by_time()), 2)), F.lit(0.0))
    df = written(df.withColumn("_step", step).withColumn("_path", F.sum("_step").over(by_time())), "paths")
    end = lambda f: f(F.struct("x", "y", "_c", "_path"), "_i")
    lines = df.filter("line_id >= 0").groupBy(*FILE, "line_id").agg(F.min("_i").alias("lo"), F.max("_i").alias("hi"), end(F.min_by).alias("a"), end(F.max_by).alias("b"))
    w = Window.partitionBy(*FILE).orderBy("lo")
    was = F.lag("b").over(w)
    path, straight = F.col("a._path") - was["_path"], F.sqrt(F.pow(F.col("a.x") - was["x"], 2) + F.pow(F.col("a.y") - was["y"], 2))
    ok = (path <= rules.bridge_m) & (F.abs(F.col("a._c") - was["_c"]) <= rules.bridge_across_m) & (path <= rules.bridge_ratio * straight)
    lines = lines.withColumn("_new", (~F.coalesce(ok, F.lit(False))).cast("int")).withColumn("_g", F.sum("_new").over(w))
    merged = lines.groupBy(*FILE, "_g").agg(F.min_by("line_id", "lo").alias("_to"), F.min("lo").alias("_lo"), F.max("hi").alias("_hi"))
    # a merged line is marked at its first row and carried on to its last
    marks = merged.select(*FILE, F.col("_lo").alias("_i"), F.struct("_to", "_hi").alias("_m"))
    df = df.join(F.broadcast(marks), [*FILE, "_i"], "left").withColumn("_m", F.last("_m", ignorenulls=True).over(by_time()))
    to = F.when(F.col("_i") <= F.col("_m._hi"), F.col("_m._to"))
    out = df.withColumn("_to", to).withColumn("line_id", F.coalesce("_to", F.lit(-1)).cast("int")).withColumn("reason", F.when(F.col("_to").isNull(), F.col("reason")))
    return out.drop("_i", "_c", "_step", "_path", "_m", "_to")


def tag_ramps(df: DataFrame) -> DataFrame:
    """Rows without a line before a file's first kept row become takeoff_ramp, those after its last landing_ramp; a file that keeps none stays."""
    w = Window.partitionBy(*FILE)
    kept = F.when(F.col("line_id") >= 0, F.col("t"))
    df = df.withColumn("_lo", F.min(kept).over(w)).withColumn("_hi", F.max(kept).over(w))
    off = F.col("line_id") < 0
    return df.withColumn("reason", F.when(off & (F.col("t") < F.col("_lo")), "takeoff_ramp").when(off & (F.col("t") > F.col("_hi")), "landing_ramp").otherwise(F.col("reason"))).drop("_lo", "_hi")


def detect_lines(df: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Adds speed_mps, heading_deg, line_id, reason and tie_line_id; everything from headings to ties."""
    df = written(headings(df, rules), "headings")
    azimuth = dominant_azimuth(df, rules).first()
    df = df.withColumn("azimuth_deg", F.lit(azimuth.azimuth_deg if azimuth else None).cast("double"))
    valid = F.col("heading_deg").isNotNull() & (F.col("speed_mps") >= rules.least_speed)
    on = valid & (axial_difference(F.col("heading_deg"), F.col("azimuth_deg")) <= rules.tolerance_deg)
    df = group_lines(df, on, rules)
    df = df.withColumn("reason", F.when(~F.coalesce(valid, F.lit(False)), "takeoff_landing_or_low_speed").when(~on, "off_azimuth_turn").otherwise(F.col("reason")))
    df = tag_ramps(bridge_gaps(df, F.col("azimuth_deg"), rules))
    ties = (F.col("line_id") < 0) & valid & (axial_difference(F.col("heading_deg"), F.col("azimuth_deg") + 90) <= rules.tolerance_deg)
    kept = df.withColumnRenamed("line_id", "_line").withColumnRenamed("reason", "_reason")
    tied = group_lines(kept.withColumn("line_id", F.col("_line")), F.coalesce(ties, F.lit(False)), rules)
    return tied.withColumnRenamed("line_id", "tie_line_id").drop("reason").withColumnRenamed("_line", "line_id").withColumnRenamed("_reason", "reason")


def turn_segments(df: DataFrame, most_gap_s: float = 1.0) -> DataFrame:
    """Adds turn_group: numbers the runs of turn rows of a file; null elsewhere."""
    turn = F.coalesce(F.col("reason").isin("off_azimuth_turn", "turn_buffer"), F.lit(False))
    df = islands(df, turn, "_run", most_gap_s)
    return df.withColumn("turn_group", F.when(F.col("_on"), F.col("_run"))).drop("_run", "_on")


def line_summary(df: DataFrame) -> DataFrame:
    """Per line: points, time span, length, centre, direction of flight and group A or B relative to the first line."""
    w = Window.partitionBy("line_id").orderBy("t", "point_id")
    step = F.coalesce(F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2)), F.lit(0.0))
    kept = df.filter("line_id >= 0").withColumn("_step", step)
    p = F.struct("t", "point_id")
    out = kept.groupBy("line_id").agg(
        F.count("*").alias("n_points"), F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.sum("_step").alias("length_m"), F.avg("x").alias("x_mean"), F.avg("y").alias("y_mean"),
        F.min_by(F.struct("x", "y"), p).alias("_a"), F.max_by(F.struct("x", "y"), p).alias("_b"),
    )
    return out.withColumn("true_deg", F.pmod(F.degrees(F.atan2(F.col("_b.y") - F.col("_a.y"), F.col("_b.x") - F.col("_a.x"))), F.lit(360.0))).drop("_a", "_b")


def direction_group(true_deg: Column, azimuth: Column) -> Column:
    """A: flown within 90 degrees of the dominant azimuth, else B."""
    return F.when(F.abs(F.pmod(true_deg - azimuth + 180, F.lit(360.0)) - 180) <= 90, "A").otherwise("B")
