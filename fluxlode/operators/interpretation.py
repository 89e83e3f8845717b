"""Interpretation of grids: depths, edges, contacts, targets and prospectivity.

Kernels work on one grid (or one window or candidate group of it) as arrays and run in parallel over many; what is found is a table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import transforms as tf
from .series import SIGMA
from .spatial import clusters, local_maxima


def _eroded(mask: np.ndarray) -> np.ndarray:
    p = np.pad(mask, 1)
    return p[1:-1, 1:-1] & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]


def euler_solutions(grid: np.ndarray, cell: float, index: float = 1.0, window_m: float = 100.0, most_error: float = 30.0, most_depth: float | None = None, x0: float = 0.0, y0: float = 0.0) -> pd.DataFrame:
    """(x, y, depth, base, error_pct) of half-overlapping windows: least squares of x Tx + y Ty + z Tz + index B."""
    known = np.isfinite(grid)
    z = np.where(known, grid, np.nanmean(grid))
    ty, tx = np.gradient(z, cell)
    tz = tf.vertical_derivative(grid, cell)
    good = _eroded(known) & np.isfinite(tz)
    w = max(5, int(round(window_m / cell)))
    most_depth = most_depth or 20 * window_m
    yy, xx = np.mgrid[: grid.shape[0], : grid.shape[1]] * cell
    out = []
    for r in range(0, grid.shape[0] - w + 1, max(1, w // 2)):
        for c in range(0, grid.shape[1] - w + 1, max(1, w // 2)):
            at = np.s_[r : r + w, c : c + w]
            ok = good[at]
            if ok.sum() < max(10, w):
                continue
            a = np.stack([tx[at][ok], ty[at][ok], tz[at][ok], np.full(ok.sum(), index)], 1)
            x, y, t = xx[at][ok], yy[at][ok], z[at][ok]
            rhs = x * a[:, 0] + y * a[:, 1] + index * t
            fit, _, rank, _ = np.linalg.lstsq(a, rhs, rcond=None)
            if rank < 4:
                continue
            left = rhs - a @ fit
            cov = np.linalg.inv(a.T @ a) * (left @ left) / max(len(rhs) - 4, 1)
            depth = fit[2]
            if not 0 < depth <= most_depth:
                continue
            error = 100 * np.sqrt(max(cov[2, 2], 0)) / depth
            inside = x.min() - window_m <= fit[0] <= x.max() + window_m and y.min() - window_m <= fit[1] <= y.max() + window_m
            if error <= most_error and inside:
                out.append((x0 + fit[0], y0 + fit[1], depth, fit[3], error))
    return pd.DataFrame(out, columns=["x", "y", "depth", "base", "error_pct"])


def edge_points(thdr: DataFrame, percentile: float = 80.0) -> DataFrame:
    """Local maxima of a horizontal-derivative grid at or above its percentile, for each grid_id (a continuation height)."""
    if "grid_id" not in thdr.columns:
        cut = thdr.agg(F.percentile("value", percentile / 100).alias("_p"))
        return local_maxima(thdr).crossJoin(F.broadcast(cut)).filter(F.col("value") >= F.col("_p")).drop("_p")
    cut = thdr.groupBy("grid_id").agg(F.percentile("value", percentile / 100).alias("_p"))
    apart = thdr.withColumn("row", F.col("row") + F.col("grid_id") * 10_000_000)  # grids don't touch one another
    return local_maxima(apart).withColumn("row", F.col("row") - F.col("grid_id") * 10_000_000).join(F.broadcast(cut), "grid_id").filter(F.col("value") >= F.col("_p")).drop("_p")


def multiscale(grid: np.ndarray, cell: float, heights: list[float]) -> list[np.ndarray]:
    """Total horizontal derivative of the grid and of its upward continuations."""
    return [tf.total_horizontal_derivative(grid if h <= 0 else tf.upward_continuation(grid, cell, h), cell) for h in heights]


def persistent(edges: DataFrame, heights: int, reach: int = 1, least: float = 0.5) -> DataFrame:
    """Edge points of grid 0 that have an edge point within `reach` cells at a share of at least `least` of all heights."""
    offsets = [F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    spread = edges.select("grid_id", F.explode(F.array(*offsets)).alias("c")).select("grid_id", "c.row", "c.col").distinct()
    count = spread.groupBy("row", "col").agg((F.count_distinct("grid_id") / heights).alias("persistence"))
    return edges.filter("grid_id = 0").join(count, ["row", "col"]).filter(F.col("persistence") >= least)


def segments(points: DataFrame, gap: float, least_points: int = 4, least_m: float = 0.0) -> DataFrame:
    """Linked points (id, x, y) as segments: points, strike (degrees from north), length along the axis, centre."""
    g = clusters(points, gap)
    axis = 0.5 * F.atan2(2 * F.covar_pop("x", "y"), F.var_pop("x") - F.var_pop("y"))
    s = g.groupBy("component").agg(F.count("*").alias("n_points"), axis.alias("_a"), F.avg("x").alias("x"), F.avg("y").alias("y")).filter(F.col("n_points") >= least_points)
    along = F.col("p.x") * F.cos("_a") + F.col("p.y") * F.sin("_a")
    size = g.alias("p").join(F.broadcast(s.select("component", "_a")), "component").groupBy("component").agg((F.max(along) - F.min(along)).alias("length_m"))
    out = s.join(size, "component").filter(F.col("length_m") >= least_m)
    return out.select("component", "n_points", F.pmod(90 - F.degrees("_a"), F.lit(180.0)).alias("strike_deg"), "length_m", "x", "y")


def rose(found: DataFrame, width: float = 10.0) -> DataFrame:
    """(bin_deg, n, length_m) of the segments' strikes."""
    return found.groupBy((F.floor(F.col("strike_deg") / width) * width).alias("bin_deg")).agg(F.count("*").alias("n"), F.sum("length_m").alias("length_m"))


def tilt_depths(tilt: DataFrame, cell: float, low: float = 1.0, high: float = 500.0) -> DataFrame:
    """(row, col, depth): where the tilt changes sign towards the next cell east or north; depth is 1 / |gradient of the tilt in radians|."""
    w, v = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    step = lambda win, k, n: F.when(F.lead(k).over(win) == F.col(k) + 1, F.lead("value").over(win))  # noqa: ARG005, E731
    back = lambda win, k: F.when(F.lag(k).over(win) == F.col(k) - 1, F.lag("value").over(win))
    t = tilt.withColumn("_e", step(w, "col", 1)).withColumn("_n", step(v, "row", 1)).withColumn("_w", back(w, "col")).withColumn("_s", back(v, "row"))
    half = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), (a - b) / (2 * cell)).otherwise(F.coalesce((a - F.col("value")) / cell, (F.col("value") - b) / cell))
    size = F.sqrt(F.pow(F.radians(half(F.col("_e"), F.col("_w"))), 2) + F.pow(F.radians(half(F.col("_n"), F.col("_s"))), 2))
    cross = (F.col("value") * F.col("_e") < 0) | (F.col("value") * F.col("_n") < 0) | (F.col("value") == 0)
    return t.filter(cross).withColumn("depth", 1 / F.nullif(size, F.lit(0.0))).filter(F.col("depth").between(low, high)).select("row", "col", "depth")


def signal_depths(signal: DataFrame, cell: float, percentile: float = 90.0, reach: int = 15) -> DataFrame:
    """(row, col, value, depth): peaks of the analytic signal, each with the distance to the nearest cell of at most half its height."""
    cut = signal.agg(F.percentile("value", percentile / 100).alias("_p"))
    peaks = local_maxima(signal).crossJoin(F.broadcast(cut)).filter(F.col("value") >= F.col("_p")).select("row", "col", "value")
    box = [F.col("row"), F.col("col")]
    cells = lambda df, spread: df.withColumn("_a", F.floor(box[0] / reach)).withColumn("_b", F.floor(box[1] / reach)) if not spread else df.withColumn("_o", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))).withColumn("_a", F.floor(box[0] / reach) + F.col("_o.i")).withColumn("_b", F.floor(box[1] / reach) + F.col("_o.j")).drop("_o")
    other = cells(signal.filter(F.col("value").isNotNull()), False).select("_a", "_b", F.col("row").alias("r2"), F.col("col").alias("c2"), F.col("value").alias("v2"))
    d = F.sqrt(F.pow(F.col("row") - F.col("r2"), 2) + F.pow(F.col("col") - F.col("c2"), 2))
    near = cells(peaks, True).join(other, ["_a", "_b"]).filter((F.col("v2") <= F.col("value") / 2) & (d <= reach))
    return near.groupBy("row", "col", "value").agg((F.min(d) * cell).alias("depth"))


def spectral_depth(grid: np.ndarray, cell: float, low: float = 15.0, high: float = 70.0) -> float:
    """Depth from the slope of the log radial power spectrum between two percentiles of the wavenumber."""
    z = tf.fill_gaps(grid)
    power = np.abs(np.fft.fft2((z - z.mean()) * np.hanning(z.shape[0])[:, None] * np.hanning(z.shape[1]))) ** 2
    _, _, k = tf.wavenumbers(z.shape, cell)
    bins = np.round(k / (2 * np.pi / (max(z.shape) * cell))).astype(int).ravel()
    n = np.bincount(bins)
    mean, at = np.bincount(bins, power.ravel()) / np.maximum(n, 1), np.bincount(bins, k.ravel()) / np.maximum(n, 1)
    ok = (n > 0) & (mean > 0) & (at > 0) & (at <= np.pi / cell)
    at, mean = at[ok], mean[ok]
    lo, hi = np.percentile(at, [low, high])
    inside = (at >= lo) & (at <= hi)
    slope = np.polyfit(at[inside], np.log(mean[inside]), 1)[0]
    return float(max(-slope / 2, 0.0))


def scaled(column: str, low: Column, high: Column) -> Column:
    share = (F.col(column) - low) / F.nullif(high - low, F.lit(0.0))
    return F.when(share.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def prospectivity(layers: DataFrame, weights: dict[str, float], threshold: float = 0.6) -> DataFrame:
    """(row, col, score, is_high): weighted mean of the layers scaled between their 2nd and 98th percentiles; a layer that is null
    in a cell leaves its weight to the others."""
    names = [n for n in weights if n in layers.columns]
    ends = layers.agg(*[F.percentile(n, [0.02, 0.98]).alias(f"_{n}") for n in names])
    df = layers.crossJoin(F.broadcast(ends))
    parts = {n: scaled(n, F.col(f"_{n}")[0], F.col(f"_{n}")[1]) for n in names}
    total = sum(F.when(p.isNotNull(), F.lit(weights[n])).otherwise(0.0) for n, p in parts.items())
    score = sum(F.coalesce(p, F.lit(0.0)) * weights[n] for n, p in parts.items()) / F.nullif(total, F.lit(0.0))
    return df.select("row", "col", score.alias("score")).withColumn("is_high", F.coalesce(F.col("score") >= threshold, F.lit(False)))


def proximity(distance: Column, decay: float = 200.0) -> Column:
    return F.exp(-distance / decay)


def proximity_scores(cells: DataFrame, features: DataFrame, decay: float = 200.0) -> DataFrame:
    """(row, col, score): exp(-distance / decay) to the nearest feature (x2, y2), however far."""
    from .spatial import nearest

    cells = cells.withColumn("_k", F.struct("row", "col"))
    near = nearest(cells, "_k", features.withColumn("_id", F.xxhash64("x2", "y2")), "_id", decay / 4)
    return near.select("row", "col", proximity(F.col("distance_m"), decay).alias("score"))


def spaced_best(scores: DataFrame, least: float, spacing: float, most: int = 20) -> DataFrame:
    """The best cells (row, col, x, y, score) of at least `least` that are `spacing` apart, best first, `most` of them: a cell goes if
    a better one that stays is nearer. Local maxima are few; each round keeps those that no open better one is near to."""
    from ..shared import written
    from .spatial import within

    top = written(local_maxima(scores.withColumn("value", F.col("score"))).filter(F.col("score") >= least).select("row", "col", "x", "y", "score").withColumn("o", F.row_number().over(Window.orderBy(F.desc("score"), "row", "col"))), "maxima")
    other = top.select(F.col("o").alias("o2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    near = written(within(top, other, spacing).filter((F.col("o2") < F.col("o")) & (F.col("d") < spacing)).select("o", "o2"), "near")
    kept, open_ = top.select("o").filter("false"), top.select("o")
    while open_.head(1):
        best = written(open_.join(near.join(open_.select(F.col("o").alias("o2")), "o2").select("o").distinct(), "o", "left_anti"), "best")
        kept = written(kept.unionByName(best), "kept")
        gone = near.join(best.select(F.col("o").alias("o2")), "o2").select("o").distinct()
        open_ = written(open_.join(best, "o", "left_anti").join(gone, "o", "left_anti"), "open")
    return top.join(kept, "o").orderBy("o").limit(most).withColumn("rank", F.row_number().over(Window.orderBy("o"))).drop("o")


def dipole_field(x, y, depth, direction, moment, px, py) -> np.ndarray:
    """Total-field anomaly (nT) of an induced dipole below (x, y); x, y of the grid are east and north."""
    dx, dy, dz = px - x, py - y, depth
    r = np.sqrt(dx * dx + dy * dy + dz * dz)
    along = (dx * direction[0] + dy * direction[1] + dz * direction[2]) / r
    return 100 * moment * (3 * along**2 - 1) / r**3


def candidates(grid: np.ndarray, cell: float, threshold: float, least_m: float, most_m: float) -> list[tuple[int, int, float]]:
    """(row, col, footprint): extremes of |grid - median| over windows of the largest footprint whose half-height part of one sign
    has an equivalent diameter in range."""
    left = grid - np.nanmedian(grid)
    size = np.where(np.isfinite(left), np.abs(left), 0)
    half = max(1, int(round(most_m / cell / 2)))
    p = np.pad(size, half)
    wide = np.lib.stride_tricks.sliding_window_view(p, (2 * half + 1, 2 * half + 1)).max((2, 3))
    out = []
    for r, c in zip(*np.nonzero((size == wide) & (size >= threshold))):
        part = (np.sign(left) == np.sign(left[r, c])) & (size >= size[r, c] / 2)
        seen, todo = {(r, c)}, [(r, c)]
        while todo:
            a, b = todo.pop()
            for q in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= q[0] < size.shape[0] and 0 <= q[1] < size.shape[1] and part[q] and q not in seen:
                    seen.add(q)
                    todo.append(q)
        diameter = 2 * np.sqrt(len(seen) * cell * cell / np.pi)
        if least_m <= diameter <= most_m:
            out.append((int(r), int(c), float(diameter)))
    return out


def fit_dipole(px, py, v, direction, x, y, depth, most_depth: float, reach: float, rounds: int = 60) -> dict:
    """Robust bounded fit of position, depth, moment (signed) and background by Levenberg-Marquardt with soft-L1 weights."""
    scale = max(1.0, 0.1 * float(np.max(np.abs(v - np.median(v)))))
    low, high = np.array([x - reach, y - reach, 0.05]), np.array([x + reach, y + reach, most_depth])
    p, lam, best = np.array([x, y, np.clip(depth, 0.05, most_depth)], float), 1e-2, None

    def solve(p, weight):
        shape = dipole_field(p[0], p[1], p[2], direction, 1.0, px, py)
        basis, root = np.stack([shape, np.ones_like(v)], 1), np.sqrt(weight)
        lin = np.linalg.lstsq(basis * root[:, None], v * root, rcond=None)[0]
        return lin, v - basis @ lin

    weight = np.ones_like(v)
    for _ in range(rounds):
        lin, left = solve(p, weight)
        cost = (2 * scale**2 * (np.sqrt(1 + (left / scale) ** 2) - 1)).sum()
        if best is None or cost < best[0]:
            best, lam = (cost, p.copy(), lin, left), max(lam / 3, 1e-9)
        else:
            p, lam = best[1].copy(), lam * 4
            if lam > 1e6:
                break
        cost, p, lin, left = best
        weight = 1 / np.sqrt(1 + (left / scale) ** 2)
        jac = np.stack([(solve_shift(p, i, 1e-4 * max(1.0, p[2]), px, py, direction, lin)) for i in range(3)], 1)
        a = (jac * weight[:, None]).T @ jac
        step = np.linalg.solve(a + lam * (np.diag(np.diag(a)) + 1e-12 * np.eye(3)), (jac * weight[:, None]).T @ left)
        p = np.clip(p + step, low, high)
        if np.abs(step).max() < 1e-6:
            break
    cost, p, lin, left = best
    spread = float(np.sum((v - v.mean()) ** 2)) or 1.0
    return {"x": float(p[0]), "y": float(p[1]), "depth": float(p[2]), "moment": float(lin[0]), "background": float(lin[1]), "quality": float(1 - (left @ left) / spread)}


def solve_shift(p, i, h, px, py, direction, lin) -> np.ndarray:
    q = p.copy()
    q[i] += h
    return lin[0] * (dipole_field(*q, direction, 1.0, px, py) - dipole_field(*p, direction, 1.0, px, py)) / h


def detect_targets(points: DataFrame, grid: np.ndarray, x0: float, y0: float, cell: float, inclination: float, declination: float, k: float = 5.0, least_m: float = 1.0, most_m: float = 20.0, window_m: float = 10.0, most_depth: float = 10.0, least_quality: float = 0.5) -> DataFrame:
    """(x, y, depth, moment, quality, footprint_m) of compact targets: candidates of the grid, each fitted to the points around it in a group of
    its own, then thinned so that of two nearer than half a window the better stays."""
    from ..functions.geo import moment_class
    from .spatial import within

    left = grid - np.nanmedian(grid)
    threshold = k * SIGMA * np.nanmedian(np.abs(left))
    found = candidates(grid, cell, threshold, least_m, most_m)
    spark = points.sparkSession
    schema = "x double, y double, depth double, moment double, background double, quality double, footprint_m double"
    if not found:
        return spark.createDataFrame([], schema + ", size_class string")
    i, d = np.radians(inclination), np.radians(declination)
    direction = np.array([np.cos(i) * np.sin(d), np.cos(i) * np.cos(d), np.sin(i)])
    seeds = spark.createDataFrame([(n, x0 + c * cell, y0 + r * cell, f) for n, (r, c, f) in enumerate(found)], "cand int, x2 double, y2 double, footprint_m double")
    near = within(points.select("x", "y", "value"), seeds, window_m)

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        if len(f) < 6:
            return pd.DataFrame(columns=["x", "y", "depth", "moment", "background", "quality", "footprint_m"])
        x, y, size = f["x2"].iloc[0], f["y2"].iloc[0], f["footprint_m"].iloc[0]
        got = fit_dipole(f["x"].to_numpy(), f["y"].to_numpy(), f["value"].to_numpy(), direction, x, y, max(size, 0.5), most_depth, window_m / 2)
        return pd.DataFrame([{**got, "footprint_m": size}])

    fits = near.groupBy("cand").applyInPandas(fit, schema).filter(F.col("quality") >= least_quality)
    rows = fits.orderBy(F.desc("quality"), "x", "y").collect()  # as many as candidates of one grid
    kept: list = []
    for r in rows:
        if all(np.hypot(r.x - q.x, r.y - q.y) >= window_m / 2 for q in kept):
            kept.append(r)
    return spark.createDataFrame(kept, schema).withColumn("size_class", moment_class(F.abs("moment")))
