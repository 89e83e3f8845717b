"""Levelling of survey lines and heading calibration. Rows: line_id, x, y, t, point_id and a value column."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import across_track, along_track
from .series import SIGMA


def apply_shifts(df: DataFrame, shifts: DataFrame, value: str, out: str = "leveled") -> DataFrame:
    """value minus its line's shift (and slope times s, if shifts has a slope); lines without one stay."""
    have = df.join(F.broadcast(shifts), "line_id", "left")
    slope = F.coalesce(F.col("slope"), F.lit(0.0)) * F.col("s") if "slope" in shifts.columns else F.lit(0.0)
    return have.withColumn(out, F.col(value) - F.coalesce(F.col("shift"), F.lit(0.0)) - slope).drop(*[c for c in shifts.columns if c != "line_id"])


def line_profiles(df: DataFrame, value: str, azimuth: float, step: float) -> DataFrame:
    """(line_id, bin, value, across): medians of the values in bins along the line."""
    a = F.lit(float(azimuth))
    s, c = along_track(F.col("x"), F.col("y"), a), across_track(F.col("x"), F.col("y"), a)
    return df.groupBy("line_id", F.floor(s / step).alias("bin")).agg(F.median(value).alias("value"), F.avg(c).alias("across"))


def line_order(profiles: DataFrame) -> DataFrame:
    """(line_id, k, next_id): lines in order across the track; a row per line, ordered in one window."""
    lines = profiles.groupBy("line_id").agg(F.avg("across").alias("c"))
    w = Window.orderBy("c", "line_id")
    return lines.select("line_id", (F.row_number().over(w) - 1).alias("k"), F.lead("line_id").over(w).alias("next_id"))


def adjacent_deltas(profiles: DataFrame, least_bins: int = 8, overlap: float = 0.25) -> DataFrame:
    """(k, line_id, next_id, delta): median difference of each line and the next over their common bins; null where
    they share too few."""
    order = line_order(profiles)
    size = profiles.groupBy("line_id").agg(F.count("*").alias("n"))
    this = profiles.select("line_id", "bin", F.col("value").alias("v0"))
    that = profiles.select(F.col("line_id").alias("next_id"), "bin", F.col("value").alias("v1"))
    pairs = this.join(F.broadcast(order.filter("next_id is not null")), "line_id").join(that, ["next_id", "bin"])
    got = pairs.groupBy("k", "line_id", "next_id").agg(F.median(F.col("v0") - F.col("v1")).alias("d"), F.count("*").alias("common"))
    out = order.filter("next_id is not null").join(got, ["k", "line_id", "next_id"], "left")
    out = out.join(F.broadcast(size), "line_id").join(F.broadcast(size.select(F.col("line_id").alias("next_id"), F.col("n").alias("n1"))), "next_id")
    fine = (F.col("common") >= least_bins) & (F.col("common") >= overlap * F.least("n", "n1"))
    return out.select("k", "line_id", "next_id", F.when(fine, F.col("d")).alias("delta"))


def chain_levels(deltas: DataFrame) -> DataFrame:
    """(k, line_id, level): each line's level relative to the first, missing differences counting as none."""
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    ends = deltas.agg(F.max(F.col("k") + 1).alias("k"), F.max_by("next_id", "k").alias("line_id")).withColumn("delta", F.lit(0.0))
    every = deltas.select("k", "line_id", F.coalesce("delta", F.lit(0.0)).alias("delta")).unionByName(ends)
    return every.select("k", "line_id", (-F.coalesce(F.sum("delta").over(w), F.lit(0.0))).alias("level"))


def running_trend(values: np.ndarray, window: int, order: int = 2, rounds: int = 3) -> np.ndarray:
    """At each place the value of a local polynomial, fitted with Cauchy weights that are renewed `rounds` times. All places are
    solved together; places outside the series have no weight, and an end with few of them a lower degree."""
    n, half = len(values), window // 2
    offset = np.arange(-half, half + 1)
    at = np.arange(n)[:, None] + offset
    inside = (at >= 0) & (at < n)
    v = np.where(inside, values[np.clip(at, 0, n - 1)], np.nan)
    degree = np.minimum(order, np.maximum(inside.sum(1) - 2, 0))
    basis = offset[:, None] ** np.arange(order + 1) / float(half) ** np.arange(order + 1)
    basis = np.where(np.arange(order + 1) <= degree[:, None, None], basis, 0.0)
    unused = np.eye(order + 1) * (np.arange(order + 1) > degree[:, None])[:, None]
    weight, out, open_ = inside.astype(float), np.zeros(n), np.ones(n, bool)
    for _ in range(rounds):
        gram = np.einsum("nw,nwi,nwj->nij", weight, basis, basis) + unused
        fit = np.linalg.solve(gram, np.einsum("nw,nwi,nw->ni", weight, basis, np.nan_to_num(v))[..., None])[..., 0]
        out = np.where(open_, fit[:, 0], out)
        left = v - np.einsum("nwi,ni->nw", basis, fit)
        scale = SIGMA * np.nanmedian(np.abs(left - np.nanmedian(left, 1, keepdims=True)), 1)
        open_ &= scale > 0  # an exact fit is final
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(inside, np.nan_to_num(1 / (1 + (left / (2 * scale[:, None])) ** 2)), 0.0)
        weight[~open_] = inside[~open_]
    return out


def statistical_shifts(df: DataFrame, value: str, azimuth: float, spacing: float, window: int = 9, most: float | None = None) -> DataFrame:
    """(line_id, shift): what each line's level departs from the running trend of its neighbours' levels.

    Empty if there are fewer than window+2 lines. Only a row per line leaves the distributed plan."""
    profiles = line_profiles(df, value, azimuth, max(1.0, 0.5 * spacing))
    levels = chain_levels(adjacent_deltas(profiles)).orderBy("k").toPandas()
    window = max(7, window)
    if len(levels) < window + 2:
        return df.sparkSession.createDataFrame([], "line_id int, shift double")
    level = levels["level"].to_numpy(float)
    jitter = level - running_trend(level, window)
    shift = jitter - jitter.mean()
    if most is not None:
        shift = np.clip(shift, -most, most)
    return df.sparkSession.createDataFrame([(int(a), float(b)) for a, b in zip(levels["line_id"], shift)], "line_id int, shift double")


def striping(levels: DataFrame, df: DataFrame, value: str) -> DataFrame:
    """One row: mean absolute second difference of the lines' levels, and its share of the values' p5-p95 range."""
    w = Window.orderBy("k")
    second = levels.select((F.col("level") - 2 * F.lag("level").over(w) + F.lag("level", 2).over(w)).alias("d2")).agg(F.avg(F.abs("d2")).alias("stripe_nt"))
    spread = df.agg((F.percentile(value, 0.95) - F.percentile(value, 0.05)).alias("range_nt"))
    return second.crossJoin(spread).withColumn("ratio", F.col("stripe_nt") / F.nullif(F.col("range_nt"), F.lit(0.0)))


def crossings(df: DataFrame, value: str, most_m: float = 15.0) -> DataFrame:
    """(line_id, tie_id, s, delta): the nearest points of each line and tie within most_m, by a join of grid cells;
    delta is line value minus tie value, each the mean of up to five points around."""
    w = Window.partitionBy("line_id", "tie_line_id").orderBy("t", "point_id").rowsBetween(-2, 2)
    rows = df.withColumn("_v", F.avg(value).over(w)).withColumn("_cx", F.floor(F.col("x") / most_m)).withColumn("_cy", F.floor(F.col("y") / most_m))
    lines = rows.filter("line_id >= 0").select("line_id", "point_id", "s", F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("_v").alias("lv"), "_cx", "_cy")
    ties = rows.filter("tie_line_id >= 0 and line_id < 0").select(F.col("tie_line_id").alias("tie_id"), F.col("point_id").alias("tie_point"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("_v").alias("tv"), "_cx", "_cy")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    ties = ties.withColumn("_o", F.explode(around)).withColumn("_cx", F.col("_cx") + F.col("_o.i")).withColumn("_cy", F.col("_cy") + F.col("_o.j")).drop("_o")
    d = F.sqrt(F.pow(F.col("lx") - F.col("tx"), 2) + F.pow(F.col("ly") - F.col("ty"), 2))
    pairs = lines.join(ties, ["_cx", "_cy"]).withColumn("d", d).filter(F.col("d") <= most_m)
    best = pairs.groupBy("line_id", "tie_id").agg(F.min_by(F.struct("s", "lv", "tv", "d"), F.struct("d", "point_id", "tie_point")).alias("b"))
    return best.select("line_id", "tie_id", F.col("b.s").alias("s"), (F.col("b.lv") - F.col("b.tv")).alias("delta"), F.col("b.d").alias("distance_m"))


def crossover_shifts(cross: DataFrame, rounds: int = 20, tol: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """((line_id, shift), (tie_id, shift)): medians of the crossings' differences, taken in turn for lines and ties until they
    settle; the lines' shifts have mean 0. The crossing table is small: lines times ties."""
    spark = cross.sparkSession
    c = cross.select("line_id", "tie_id", "delta").toPandas()
    line, tie = c.groupby("line_id")["delta"].median() * 0, c.groupby("tie_id")["delta"].median() * 0
    for _ in range(rounds):
        new = (c["delta"] + c["tie_id"].map(tie)).groupby(c["line_id"]).median()
        back = (new.reindex(c["line_id"]).to_numpy() - c["delta"])
        new_tie = back.groupby(c["tie_id"]).median()
        new, new_tie = new - new.mean(), new_tie - new.mean()
        change = max((new - line).abs().max(), (new_tie - tie).abs().max()) if len(c) else 0.0
        line, tie = new, new_tie
        if change < tol:
            break
    make = lambda s, name: spark.createDataFrame([(int(k), float(v)) for k, v in s.items()], f"{name} int, shift double")
    return make(line, "line_id"), make(tie, "tie_id")


def local_plane_offset(df: DataFrame, value: str, spacing: float, quiet: float = 40.0, factor: float = 2.0) -> DataFrame:
    """One row (offset, spread, n): heading error between groups A and B. Around each centre of a grid, the value is fitted by a plane
    and a step of +-1/2 for the group, from sums that are combined before the shuffle; of the quietest fits the median counts."""
    reach = factor * spacing
    n = int(np.ceil(factor))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-n, n + 1) for j in range(-n, n + 1)])
    p = df.withColumn("_o", F.explode(near)).withColumn("gx", F.floor(F.col("x") / spacing) + F.col("_o.i")).withColumn("gy", F.floor(F.col("y") / spacing) + F.col("_o.j"))
    p = p.withColumn("u", F.col("x") - (F.col("gx") + 0.5) * spacing).withColumn("w", F.col("y") - (F.col("gy") + 0.5) * spacing).filter(F.sqrt(F.col("u") ** 2 + F.col("w") ** 2) <= reach)
    p = p.withColumn("h", F.when(F.col("group") == "A", -0.5).otherwise(0.5)).withColumn("one", F.lit(1.0)).withColumn("v", F.col(value).cast("double"))
    basis = ("one", "u", "w", "h")
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for i, a in enumerate(basis) for b in basis[i:]] + [F.sum(F.col(a) * F.col("v")).alias(f"{a}v") for a in basis]
    g = p.groupBy("gx", "gy").agg(*sums, F.sum(F.col("v") * F.col("v")).alias("vv"), F.count_distinct("line_id").alias("lines"), F.sum((F.col("h") < 0).cast("int")).alias("na"), F.sum((F.col("h") > 0).cast("int")).alias("nb"))
    g = g.filter("lines >= 3 and na >= 12 and nb >= 12")

    def solve(frames):
        for f in frames:
            gram = np.empty((len(f), 4, 4))
            for i, a in enumerate(basis):
                for j in range(i, 4):
                    gram[:, i, j] = gram[:, j, i] = f[f"{a}{basis[j]}"]
            rhs = np.stack([f[f"{a}v"] for a in basis], 1)
            scale = np.sqrt(np.einsum("nii->ni", gram))
            fine = np.linalg.matrix_rank(gram / np.maximum(scale[:, :, None] * scale[:, None, :], 1e-300), tol=1e-8) == 4
            fit = np.linalg.solve(gram[fine], rhs[fine][:, :, None])[:, :, 0]
            left = np.maximum(f["vv"].to_numpy()[fine] - (fit * rhs[fine]).sum(1), 0) / f["oneone"].to_numpy()[fine]
            import pandas as pd

            yield pd.DataFrame({"offset": fit[:, 3], "residual": np.sqrt(left)})

    fits = g.mapInPandas(solve, "offset double, residual double")
    cut = fits.agg(F.percentile("residual", quiet / 100).alias("_q"))
    calm = fits.crossJoin(F.broadcast(cut)).filter(F.col("residual") <= F.col("_q"))
    middle = calm.agg(F.median("offset").alias("_m"))
    return calm.crossJoin(F.broadcast(middle)).agg(F.max("_m").alias("offset"), (SIGMA * F.median(F.abs(F.col("offset") - F.col("_m")))).alias("spread"), F.count("*").alias("n"))


def heading_shift(group: Column, offset: Column) -> Column:
    """A: -offset/2, B: +offset/2."""
    return F.when(group == "A", -offset / 2).otherwise(offset / 2)


def turn_calibration(df: DataFrame, least: int = 15) -> DataFrame:
    """(theta, phi, deviation) of rows in turns of at least `least` points: the value less its turn's mean."""
    w = Window.partitionBy("source_file_index", "turn_group")
    out = df.filter("turn_group is not null").withColumn("_n", F.count("*").over(w)).withColumn("deviation", F.col("value") - F.avg("value").over(w))
    return out.filter(F.col("_n") >= least).select("theta", "phi", "deviation")


def angular_coverage(df: DataFrame) -> DataFrame:
    return df.agg(F.min("theta").alias("theta_min"), F.max("theta").alias("theta_max"), F.min("phi").alias("phi_min"), F.max("phi").alias("phi_max"))


def file_offsets(df: DataFrame, value: str) -> DataFrame:
    """Per file: median, its difference from the whole survey's, and whether that exceeds max(3 sigma of first differences, 1)."""
    w = Window.partitionBy("source_file_index").orderBy("t", "point_id")
    steps = df.select((F.col(value) - F.lag(value).over(w)).alias("d")).filter("d is not null")
    middle = steps.agg(F.median("d").alias("_m"))
    sigma = steps.crossJoin(F.broadcast(middle)).agg((SIGMA * F.median(F.abs(F.col("d") - F.col("_m")))).alias("_s"))
    whole = df.agg(F.median(value).alias("_all"))
    files = df.groupBy("source_file_index").agg(F.median(value).alias("median"), F.count("*").alias("n"))
    out = files.crossJoin(F.broadcast(sigma)).crossJoin(F.broadcast(whole)).withColumn("offset", F.col("median") - F.col("_all"))
    return out.withColumn("is_off", F.abs("offset") > F.greatest(3 * F.col("_s"), F.lit(1.0))).select("source_file_index", "n", "median", "offset", "is_off")


def line_passes(df: DataFrame, value: str) -> DataFrame:
    """Per line: axis direction (0..180), centre, roughness (4th-difference rms) and direction of flight along the axis."""
    from .series import difference

    d = df.withColumn("_d", difference(value, 4, ["line_id"], ["t", "point_id"]))
    p = F.struct("t", "point_id")
    g = d.groupBy("line_id").agg(
        F.pmod(F.degrees(0.5 * F.atan2(2 * F.covar_samp("x", "y"), F.var_samp("x") - F.var_samp("y"))), F.lit(180.0)).alias("axis_deg"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("n"),
        F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rough"), F.min_by(F.struct("x", "y"), p).alias("_a"), F.max_by(F.struct("x", "y"), p).alias("_b"),
    )
    sign = F.signum((F.col("_b.x") - F.col("_a.x")) * F.cos(F.radians("axis_deg")) + (F.col("_b.y") - F.col("_a.y")) * F.sin(F.radians("axis_deg")))
    return g.withColumn("direction", sign.cast("int")).drop("_a", "_b")


def pass_pairs(passes: DataFrame, across_m: float, angle_deg: float) -> DataFrame:
    """(a, b) of passes over the same line: near parallel, and each centre near the other's axis. Centres meet by cells of the
    angle and of the axis' distance from the origin, so no pair that is far apart is formed."""
    from ..functions.geo import axial_difference

    bins = F.floor(F.col("axis_deg") / angle_deg)
    count = int(np.ceil(180 / angle_deg))
    p = passes.select("line_id", "axis_deg", "cx", "cy", bins.alias("_b"))
    near = p.withColumn("_b", F.explode(F.array(*[F.pmod(F.col("_b") + i, F.lit(count)) for i in (-1, 0, 1)])))
    q = p.select(*[F.col(c).alias(f"{c}2") for c in ("line_id", "axis_deg", "cx", "cy")], "_b")
    off = lambda a: F.abs(across_track(F.col("cx2") - F.col("cx"), F.col("cy2") - F.col("cy"), F.col(a)))
    on = (F.col("line_id") < F.col("line_id2")) & (axial_difference(F.col("axis_deg"), F.col("axis_deg2")) <= angle_deg) & (off("axis_deg") <= across_m) & (off("axis_deg2") <= across_m)
    return near.join(q, "_b").filter(on).select(F.col("line_id").alias("a"), F.col("line_id2").alias("b")).distinct()


def pass_groups(passes: DataFrame, across_m: float, angle_deg: float) -> DataFrame:
    """(line_id, grp): passes that are the same line, directly or through others; grp is the smallest line_id. Lines on their own are groups too."""
    from .spatial import components

    pairs = pass_pairs(passes, across_m, angle_deg).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    found = components(passes.select(F.col("line_id").cast("long").alias("id")), pairs)
    return found.select(F.col("id").cast("int").alias("line_id"), F.col("component").cast("int").alias("grp"))


def heading_is_reliable(offset: DataFrame, enabled: bool = True) -> DataFrame:
    """offset (offset, spread, n) with `apply`: only if the correction is wanted, there is an estimate, and it exceeds its own spread."""
    fine = F.col("offset").isNotNull() & (F.abs("offset") > F.coalesce("spread", F.lit(0.0)))
    return offset.withColumn("apply", F.lit(enabled) & F.coalesce(fine, F.lit(False)))


def resolve_duplicates(df: DataFrame, value: str, groups: DataFrame, azimuth: float) -> DataFrame:
    """df with is_duplicate: in each group's common stretch only the smoothest pass stays. groups: (line_id, grp)."""
    passes = line_passes(df, value).select("line_id", "rough")
    s = along_track(F.col("x"), F.col("y"), F.lit(float(azimuth)))
    rows = df.withColumn("_s", s).join(F.broadcast(groups), "line_id", "left")
    ends = rows.filter("grp is not null").groupBy("grp", "line_id").agg(F.min("_s").alias("a"), F.max("_s").alias("b"))
    best = ends.join(passes, "line_id").withColumn("_r", F.row_number().over(Window.partitionBy("grp").orderBy("rough", "line_id")))
    common = ends.groupBy("grp").agg(F.max("a").alias("lo"), F.min("b").alias("hi"), F.count("*").alias("_n")).filter("_n > 1")
    keep = best.filter("_r = 1").select("grp", F.col("line_id").alias("_keep")).join(common, "grp")
    out = rows.join(F.broadcast(keep), "grp", "left")
    return out.withColumn("is_duplicate", F.coalesce((F.col("line_id") != F.col("_keep")) & F.col("_s").between(F.col("lo"), F.col("hi")), F.lit(False))).select(*df.columns, "is_duplicate")


def repeat_deviation(df: DataFrame, value: str, groups: DataFrame, azimuth: float, step: float, directions: DataFrame | None = None) -> DataFrame:
    """Per group of passes: sigma of the deviations from the bins' means within one direction, and the mean absolute difference of the two directions.
    directions: (line_id, direction), by default line_passes'."""
    s = F.floor(along_track(F.col("x"), F.col("y"), F.lit(float(azimuth))) / step)
    passes = line_passes(df, value).select("line_id", "direction") if directions is None else directions
    bins = df.join(F.broadcast(groups), "line_id").join(F.broadcast(passes), "line_id").groupBy("grp", "line_id", "direction", s.alias("bin")).agg(F.avg(value).alias("v"))
    same = bins.withColumn("_d", F.col("v") - F.avg("v").over(Window.partitionBy("grp", "direction", "bin"))).withColumn("_n", F.count("*").over(Window.partitionBy("grp", "direction", "bin")))
    sigma = same.filter("_n > 1").groupBy("grp").agg(F.stddev_pop("_d").alias("sigma"), F.count("*").alias("n"))
    both = bins.groupBy("grp", "bin").agg(F.avg(F.when(F.col("direction") > 0, F.col("v"))).alias("f"), F.avg(F.when(F.col("direction") < 0, F.col("v"))).alias("r"))
    heading = both.filter("f is not null and r is not null").groupBy("grp").agg(F.avg(F.abs(F.col("f") - F.col("r"))).alias("heading_error"))
    return sigma.join(heading, "grp", "full")


def nearest_pair_offset(df: DataFrame, value: str, azimuth: float, spacing: float, quiet: float = 40.0, most_m: float | None = None, points: int = 5) -> DataFrame:
    """One row (offset, n): median of B minus A over points of neighbouring lines flown in opposite directions, each with the nearest point of the other
    line; only the quietest share by the range of the values around them counts."""
    from .spatial import within

    most_m = most_m or 1.5 * spacing
    w = Window.partitionBy("line_id").orderBy("t", "point_id").rowsBetween(-(points // 2), points // 2)
    p = df.filter("line_id >= 0").withColumn("_range", F.max(value).over(w) - F.min(value).over(w))
    order = p.groupBy("line_id", "group").agg(F.avg(across_track(F.col("x"), F.col("y"), F.lit(float(azimuth)))).alias("c"))
    o = Window.orderBy("c", "line_id")
    pairs = order.select("line_id", "group", F.lead("line_id").over(o).alias("next_id"), F.lead("group").over(o).alias("next_group")).filter("group <> next_group").select("line_id", "next_id")
    left = p.join(F.broadcast(pairs), "line_id").select("point_id", "next_id", "x", "y", F.col(value).alias("v"), "group", "_range")
    right = p.select(F.col("line_id").alias("next_id"), F.col("point_id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col(value).alias("v2"))
    best = within(left, right, most_m, on=("next_id",)).groupBy("point_id", "group", "v", "_range").agg(F.min_by("v2", F.struct("d", "id2")).alias("v2"))
    cut = best.agg(F.percentile("_range", quiet / 100).alias("_q"))
    calm = best.crossJoin(F.broadcast(cut)).filter(F.col("_range") <= F.col("_q"))
    return calm.agg(F.median(F.when(F.col("group") == "A", F.col("v2") - F.col("v")).otherwise(F.col("v") - F.col("v2"))).alias("offset"), F.count("*").alias("n"))


def crossover_lines(cross: DataFrame, ties: DataFrame, least: int = 3) -> DataFrame:
    """(line_id, shift, slope): the line through each survey line's crossing differences along s, ties' shifts added first; lines with fewer crossings
    than `least` get their median and no slope."""
    c = cross.join(F.broadcast(ties.withColumnRenamed("shift", "_t")), "tie_id", "left").withColumn("_d", F.col("delta") + F.coalesce("_t", F.lit(0.0)))
    g = c.groupBy("line_id").agg(F.count("*").alias("n"), F.regr_slope("_d", "s").alias("_b"), F.regr_intercept("_d", "s").alias("_a"), F.median("_d").alias("_m"))
    fine = (F.col("n") >= least) & F.col("_b").isNotNull()
    return g.select("line_id", F.when(fine, F.col("_a")).otherwise(F.col("_m")).alias("shift"), F.when(fine, F.col("_b")).otherwise(0.0).alias("slope"))


def run_repeatability(df: DataFrame, value: str, azimuth: float, step: float, across_m: float, angle_deg: float = 10.0) -> DataFrame:
    """Passes of the same line found and compared: repeat_deviation's figures per group with the number of its passes, groups of one left out."""
    from ..shared import written

    groups = written(pass_groups(line_passes(df, value), across_m, angle_deg), "groups")
    sizes = groups.groupBy("grp").agg(F.count("*").alias("n_passes")).filter("n_passes > 1")
    return repeat_deviation(df, value, groups.join(sizes, "grp", "left_semi"), azimuth, step).join(sizes, "grp")


def heading_calibration(uploaded: DataFrame | None, turns: DataFrame | None, most_nt: float = 3.0, least: int = 30):
    """(map, report): the heading map of the uploaded calibration, else of the survey's own turns, if what cross-validation leaves is at most most_nt.

    Both are tables (theta, phi, deviation) of one calibration flight or one survey's turns, which are fitted on the driver."""
    from .surfaces import HeadingMap, cross_validate

    for source, table in (("uploaded", uploaded), ("turns", turns)):
        if table is None:
            continue
        rows = table.select("theta", "phi", "deviation").toPandas()
        if len(rows) < least:
            continue
        left, _ = cross_validate(rows.theta, rows.phi, rows.deviation)
        report = {"source": source, "n": len(rows), "left_nt": left, "applied": left <= most_nt}
        return (HeadingMap(rows.theta.to_numpy(), rows.phi.to_numpy(), rows.deviation.to_numpy(), least) if left <= most_nt else None), report
    return None, {"source": None, "applied": False}
