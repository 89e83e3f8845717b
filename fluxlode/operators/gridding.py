"""Points to grids. A long grid has rows (row, col, northing, easting, value); row grows north, col east.

A packed grid is one row (grid_id, ny, nx, x0, y0, cell, values array<double>), which the kernels take; many grids run in parallel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import written

MOST_CELLS = 3_000_000


def lattice(points: DataFrame, cell: float, most: float = MOST_CELLS) -> tuple[float, float, int, int]:
    """(x0, y0, nx, ny): nodes at exact spacing from the points' lower left corner; one row of bounds reaches the driver. Grids that are
    packed or inverted have `most` cells; long ones need no bound."""
    b = points.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d")).first()
    nx, ny = int(round((b.b - b.a) / cell)) + 1, int(round((b.d - b.c) / cell)) + 1
    if nx * ny > most:
        raise ValueError(f"{nx * ny} cells; choose larger cells")
    return b.a, b.c, nx, ny


def nodes(spark, x0: float, y0: float, nx: int, ny: int, cell: float) -> DataFrame:
    at = spark.range(nx * ny).select(F.floor(F.col("id") / nx).cast("int").alias("row"), (F.col("id") % nx).cast("int").alias("col"))
    return at.select("row", "col", (F.lit(y0) + F.col("row") * cell).alias("northing"), (F.lit(x0) + F.col("col") * cell).alias("easting"))


def boxing(points: DataFrame, value: str, x0: float, y0: float, cell: float) -> DataFrame:
    """(row, col, value, n): mean of the points nearest to each node; nodes without points are left out."""
    index = lambda c, o: F.floor((F.col(c) - o) / cell + 0.5).cast("int")
    return points.filter(F.col(value).isNotNull()).groupBy(index("y", y0).alias("row"), index("x", x0).alias("col")).agg(F.avg(value).alias("value"), F.count("*").alias("n"))


def nearest_grid(points: DataFrame, value: str, x0: float, y0: float, nx: int, ny: int, cell: float, radius: float) -> DataFrame:
    """Every node with the value of the nearest point within `radius` (ties to the smaller point_id), its distance and the confidence 1 - distance/radius."""
    grid = nodes(points.sparkSession, x0, y0, nx, ny, cell)
    first = lambda c, o: F.greatest(F.floor((F.col(c) - radius - o) / cell), F.lit(0))
    last = lambda c, o, n: F.least(F.ceil((F.col(c) + radius - o) / cell), F.lit(n - 1))
    side = lambda c, o, n: F.explode(F.when(first(c, o) <= last(c, o, n), F.sequence(first(c, o), last(c, o, n))))
    pts = points.filter(F.col(value).isNotNull()).select("point_id", "x", "y", F.col(value).alias("value"))
    pairs = pts.withColumn("row", side("y", y0, ny)).withColumn("col", side("x", x0, nx))  # each point goes to the nodes around it
    far = F.sqrt(F.pow(F.lit(x0) + F.col("col") * cell - F.col("x"), 2) + F.pow(F.lit(y0) + F.col("row") * cell - F.col("y"), 2))
    best = pairs.withColumn("d", far).filter(F.col("d") <= radius).groupBy(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).agg(F.min(F.struct("d", "point_id", "value")).alias("_b"))
    out = grid.join(best, ["row", "col"], "left").withColumn("value", F.col("_b.value")).withColumn("distance_m", F.col("_b.d"))
    confidence = F.when(F.col("distance_m").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("distance_m") / radius))).otherwise(0.0)
    return out.select("row", "col", "northing", "easting", "value", "distance_m", confidence.alias("confidence"))


def auto_radius(cell: float, gap: float | None) -> float:
    return max(2 * cell, 1.2 * gap) if gap else 2 * cell


def auto_radius_of(cell, gap):
    """auto_radius of columns; gap may be null."""
    return F.greatest(2 * cell, 1.2 * gap)


def cell_size_advice(spacing: float, cell: float) -> str | None:
    ratio = spacing / cell
    return "cells are coarse for this line spacing" if ratio < 3 else "cells are fine for this line spacing" if ratio > 8 else None


def pack(grid: DataFrame, keys=()) -> DataFrame:
    """One row a grid: values in row-major order, null where a cell is missing. A grid is bounded by MOST_CELLS."""
    b = grid.groupBy(*keys).agg(F.min("row").alias("_r0"), F.max("row").alias("_r1"), F.min("col").alias("_c0"), F.max("col").alias("_c1"), F.min("easting").alias("x0"), F.min("northing").alias("y0"), F.map_from_entries(F.collect_list(F.struct(F.struct("row", "col"), "value"))).alias("_m"))
    at = lambda i: F.struct((F.col("_r0") + F.floor(i / F.col("nx"))).cast("int").alias("row"), (F.col("_c0") + i % F.col("nx")).cast("int").alias("col"))
    b = b.withColumn("ny", F.col("_r1") - F.col("_r0") + 1).withColumn("nx", F.col("_c1") - F.col("_c0") + 1)
    return b.withColumn("values", F.transform(F.sequence(F.lit(0), F.col("ny") * F.col("nx") - 1), lambda i: F.try_element_at(F.col("_m"), at(i)))).select(*keys, "ny", "nx", "x0", "y0", "values")


def by_kernel(grid: DataFrame, kernel, keys=("grid_id",), out: str = "value") -> DataFrame:
    """grid (keys, row, col, northing, easting, value) with each grid's values replaced by kernel(2-D array, cell); NaN is no data."""
    schema = T.StructType([*grid.select(*keys, "row", "col", "northing", "easting").schema.fields, T.StructField(out, T.DoubleType())])

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["row", "col"])
        r, c = f["row"] - f["row"].min(), f["col"] - f["col"].min()
        full = np.full((int(r.max()) + 1, int(c.max()) + 1), np.nan)
        full[r, c] = f["value"].astype(float)
        step = np.diff(np.unique(f["easting"]))
        result = kernel(full, float(step.min()) if len(step) else 1.0)
        done = f[[*keys, "row", "col", "northing", "easting"]].copy()
        done[out] = result[r, c]
        return done

    return grid.groupBy(*keys).applyInPandas(run, schema)


def polynomial_residual(grid: DataFrame, order: int = 1) -> DataFrame:
    """grid with the residual from a polynomial surface; its normal equations are sums over all cells, the solution is a handful of numbers."""
    ends = grid.agg(F.avg("easting").alias("a"), F.avg("northing").alias("b"), F.max(F.abs("easting")).alias("c"), F.max(F.abs("northing")).alias("d")).first()
    u, w = (F.col("easting") - ends.a) / (ends.c or 1.0), (F.col("northing") - ends.b) / (ends.d or 1.0)
    terms = [F.pow(u, F.lit(i)) * F.pow(w, F.lit(j)) for i in range(order + 1) for j in range(order + 1 - i)]
    known = grid.filter(F.col("value").isNotNull())
    sums = known.agg(*[F.sum(a * b) for a in terms for b in terms], *[F.sum(a * F.col("value")) for a in terms]).first()
    n = len(terms)
    fit = np.linalg.lstsq(np.array(sums[: n * n]).reshape(n, n), np.array(sums[n * n :]), rcond=None)[0]
    surface = sum(float(c) * t for c, t in zip(fit, terms))
    return grid.withColumn("residual", F.col("value") - surface)


def minimum_curvature(known: np.ndarray, rounds: int = 1500, tol: float = 1e-4, damping: float = 0.5) -> np.ndarray:
    """Fills NaN so that the surface bends least, by damped relaxation of the biharmonic stencil; coarse grids start finer ones."""
    fixed = np.isfinite(known)
    if not fixed.any():
        return known.copy()
    if min(known.shape) > 12:
        coarse = block_mean(known, 3)
        start = upsample(minimum_curvature(coarse, rounds, tol, damping), 3, known.shape)
        rounds = min(rounds, 300)
    else:
        start = np.full(known.shape, np.nanmean(known))
    z = np.where(fixed, known, start)
    span = np.nanmax(known) - np.nanmin(known) or 1.0
    for _ in range(rounds):
        p = np.pad(z, 2, mode="reflect", reflect_type="odd") if min(z.shape) > 2 else np.pad(z, 2, mode="edge")
        m = lambda i, j: p[2 + i : 2 + i + z.shape[0], 2 + j : 2 + j + z.shape[1]]  # noqa: B023, E731
        ring = 8 * (m(0, 1) + m(0, -1) + m(1, 0) + m(-1, 0)) - 2 * (m(1, 1) + m(1, -1) + m(-1, 1) + m(-1, -1)) - (m(0, 2) + m(0, -2) + m(2, 0) + m(-2, 0))
        new = np.where(fixed, known, z + damping * (ring / 20 - z))
        change = np.abs(new - z).max()
        z = new
        if change < tol * span:
            break
    return z


def block_mean(a: np.ndarray, k: int) -> np.ndarray:
    ny, nx = -(-a.shape[0] // k), -(-a.shape[1] // k)
    full = np.full((ny * k, nx * k), np.nan)
    full[: a.shape[0], : a.shape[1]] = a
    blocks = full.reshape(ny, k, nx, k)
    count = np.isfinite(blocks).sum((1, 3))
    return np.where(count > 0, np.nansum(blocks, (1, 3)) / np.maximum(count, 1), np.nan)


def upsample(a: np.ndarray, k: int, shape: tuple[int, int]) -> np.ndarray:
    at = lambda n, m: np.clip((np.arange(n) - (k - 1) / 2) / k, 0, m - 1)
    y, x = at(shape[0], a.shape[0]), at(shape[1], a.shape[1])
    y0, x0 = np.minimum(y.astype(int), max(a.shape[0] - 2, 0)), np.minimum(x.astype(int), max(a.shape[1] - 2, 0))
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    return (a[y0][:, x0] * (1 - fy) + a[y1][:, x0] * fy) * (1 - fx) + (a[y0][:, x1] * (1 - fy) + a[y1][:, x1] * fy) * fx


def biharmonic_spline(x: np.ndarray, y: np.ndarray, v: np.ndarray, gx: np.ndarray, gy: np.ndarray, damping: float = 1e-8) -> np.ndarray:
    """Green's-function spline through the points, with the mean taken out; damping steadies close points."""

    def green(dx, dy):
        r = np.hypot(dx, dy)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(r > 0, r * r * (np.log(r) - 1), 0.0)

    scale = max(np.ptp(x), np.ptp(y), 1e-9)
    mean = v.mean()
    matrix = green((x[:, None] - x) / scale, (y[:, None] - y) / scale)
    force = np.linalg.solve(matrix.T @ matrix + damping * np.trace(matrix.T @ matrix) / len(x) * np.eye(len(x)), matrix.T @ (v - mean))
    return green((gx[..., None] - x) / scale, (gy[..., None] - y) / scale) @ force + mean


def contour_levels(low: float, high: float, interval: float | None = None, n: int = 10) -> list[float]:
    if interval:
        return [float(k * interval) for k in range(int(np.ceil(low / interval)), int(np.floor(high / interval)) + 1)]
    return [low + (high - low) * (k + 1) / (n + 1) for k in range(n)]


def contour_segments(grid: DataFrame, levels: list[float]) -> DataFrame:
    """(level, ax, ay, bx, by): pieces of iso-lines, by marching the two triangles of every square of cells. Each square needs its
    own four corners only, which the cell sends to the squares it belongs to."""
    corner = F.explode(F.array(*[F.struct((F.col("row") - i).alias("r"), (F.col("col") - j).alias("c"), F.lit(i * 2 + j).alias("k")) for i in (0, 1) for j in (0, 1)]))
    sent = grid.filter(F.col("value").isNotNull()).select(corner.alias("s"), "value", "easting", "northing")
    p = lambda k: F.max(F.when(F.col("s.k") == k, F.struct("value", "easting", "northing"))).alias(f"p{k}")
    squares = sent.groupBy("s.r", "s.c").agg(*[p(k) for k in range(4)]).filter("p0 is not null and p1 is not null and p2 is not null and p3 is not null")
    tri = squares.select(F.explode(F.array(F.struct(F.col("p0").alias("a"), F.col("p1").alias("b"), F.col("p2").alias("c")), F.struct(F.col("p3").alias("a"), F.col("p1").alias("b"), F.col("p2").alias("c")))).alias("t"))
    tri = tri.withColumn("level", F.explode(F.array(*[F.lit(float(v)) for v in levels])))

    def cut(a, b):
        va, vb, lv = F.col(f"t.{a}.value"), F.col(f"t.{b}.value"), F.col("level")
        share = (lv - va) / (vb - va)
        at = F.struct((F.col(f"t.{a}.easting") + share * (F.col(f"t.{b}.easting") - F.col(f"t.{a}.easting"))).alias("x"), (F.col(f"t.{a}.northing") + share * (F.col(f"t.{b}.northing") - F.col(f"t.{a}.northing"))).alias("y"))
        return F.when((va < lv) != (vb < lv), at)

    ends = F.array_compact(F.array(cut("a", "b"), cut("b", "c"), cut("a", "c")))
    got = tri.withColumn("_e", ends).filter(F.size("_e") == 2)
    return got.select("level", F.col("_e")[0]["x"].alias("ax"), F.col("_e")[0]["y"].alias("ay"), F.col("_e")[1]["x"].alias("bx"), F.col("_e")[1]["y"].alias("by"))


def stretch_stops(grid: DataFrame, fractions: list[float], kind: str = "linear") -> DataFrame:
    """One row of legend stops: linear between the ends, quantile, or normal about the median."""
    v = grid.filter(F.col("value").isNotNull())
    if kind == "quantile":
        return v.agg(F.percentile("value", fractions).alias("stops"))
    if kind == "normal":
        m = v.agg(F.median("value").alias("m"))
        s = v.crossJoin(F.broadcast(m)).agg(F.max("m").alias("m"), (1.4826 * F.median(F.abs(F.col("value") - F.col("m")))).alias("s"))
        return s.select(F.transform(F.array(*map(F.lit, fractions)), lambda f: F.col("m") + (f * 6 - 3) * F.col("s")).alias("stops"))
    e = v.agg(F.min("value").alias("a"), F.max("value").alias("b"))
    return e.select(F.transform(F.array(*map(F.lit, fractions)), lambda f: F.col("a") + f * (F.col("b") - F.col("a"))).alias("stops"))


def equalized(grid: DataFrame) -> DataFrame:
    """grid with `rank`, the share of cells that are smaller: equal counts below equal ranks. Counts of distinct
    values lie in ranges, one task each; a row a range is added up in one window."""
    counts = grid.filter(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("_n"))
    spread = written(counts.repartitionByRange("value").withColumn("_part", F.spark_partition_id()), "ranges")
    parts = spread.groupBy("_part").agg(F.sum("_n").alias("_m"))
    before = parts.select("_part", F.coalesce(F.sum("_m").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    below = spread.join(F.broadcast(before), "_part").select("value", (F.col("_before") + F.coalesce(F.sum("_n").over(w), F.lit(0))).alias("_below"))
    total = grid.agg(F.count("value").alias("_t"))
    return grid.join(below, "value", "left").crossJoin(F.broadcast(total)).withColumn("rank", F.col("_below") / F.greatest(F.col("_t") - 1, F.lit(1))).drop("_below", "_t")
