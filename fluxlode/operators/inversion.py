"""3-D susceptibility inversion: mesh, prism kernel, data-space solution over partitions of cells, and slices of the model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def build_mesh(columns: DataFrame, cell: float, depth: float, layers: int, growth: float = 1.15) -> DataFrame:
    """columns (row, col, x, y, ground) -> cells with z (elevation of the centre), thickness_m and active (below the ground). The
    layers thicken downwards by `growth` and start at the highest ground."""
    share = np.array([growth**i for i in range(layers)])
    thick = depth * share / share.sum()
    tops = np.r_[0, np.cumsum(thick)[:-1]]
    graded = F.array(*[F.struct(F.lit(i).alias("layer"), F.lit(float(t)).alias("thickness_m"), F.lit(float(a + t / 2)).alias("below")) for i, (t, a) in enumerate(zip(thick, tops))])
    top = columns.agg(F.max("ground").alias("_top"))
    m = columns.crossJoin(F.broadcast(top)).withColumn("l", F.explode(graded))
    z = F.col("_top") - F.col("l.below")
    return m.select("row", "col", F.col("l.layer").alias("layer"), "x", "y", z.alias("z"), F.col("l.thickness_m").alias("thickness_m"), (F.col("_top") - z).alias("depth_m"), (z < F.col("ground")).alias("active"))


def prism(ox, oy, oz, x, y, z, cell: float, thick, direction, intensity: float) -> np.ndarray:
    """nT at observations (rows) of prisms (columns) of unit susceptibility: induced field, total-field projection."""
    sign = np.array([-1.0, 1.0])
    out = np.zeros((len(ox), len(x)))
    e, n, u = direction
    d = -u  # down
    for i, si in enumerate(sign):
        for j, sj in enumerate(sign):
            for k, sk in enumerate(sign):
                a = x[None] + si * cell / 2 - ox[:, None]
                b = y[None] + sj * cell / 2 - oy[:, None]
                c = oz[:, None] - (z[None] - sk * thick[None] / 2)
                r = np.sqrt(a * a + b * b + c * c) + 1e-12
                parity = si * sj * sk
                with np.errstate(divide="ignore", invalid="ignore"):
                    t = e * n * np.log((r + c)) + e * d * np.log(np.maximum(r + b, 1e-12)) + n * d * np.log(np.maximum(r + a, 1e-12))
                    t = 2 * t - e * e * np.arctan2(b * c, a * r) - n * n * np.arctan2(a * c, b * r) - d * d * np.arctan2(a * b, c * r)
                out += parity * t
    return out * intensity / (4 * np.pi)


def _direction(inclination: float, declination: float) -> np.ndarray:
    i, d = np.radians(inclination), np.radians(declination)
    return np.array([np.cos(i) * np.sin(d), np.cos(i) * np.cos(d), -np.sin(i)])


def _rows(f: pd.DataFrame, obs: np.ndarray, cell: float, direction, intensity: float) -> np.ndarray:
    return prism(obs[:, 0], obs[:, 1], obs[:, 2], f["x"].to_numpy(), f["y"].to_numpy(), f["z"].to_numpy(), cell, f["thickness_m"].to_numpy(), direction, intensity)


def sensitivity(mesh: DataFrame, observations: pd.DataFrame, cell: float, inclination: float, declination: float, intensity: float) -> DataFrame:
    """Active cells with `g`, each one's column of the kernel. Observations (x, y, z) are bounded by the caller (a few thousand) and broadcast;
    cells are spread over partitions, so the matrix never is in one place."""
    obs = mesh.sparkSession.sparkContext.broadcast(observations[["x", "y", "z"]].to_numpy(float))
    direction = _direction(inclination, declination)
    cells = mesh.filter("active").select("row", "col", "layer", "x", "y", "z", "thickness_m", "depth_m")

    def run(frames):
        for f in frames:
            for a in range(0, len(f), 256):
                part = f.iloc[a : a + 256]
                yield part.assign(g=list(_rows(part, obs.value, cell, direction, intensity).T))

    return cells.mapInPandas(run, T.StructType([*cells.schema.fields, T.StructField("g", T.ArrayType(T.DoubleType()))]))


def _summed(df: DataFrame, f, size: int, width: int = 1) -> np.ndarray:
    """Sum over partitions of an array f(frame) of `size` rows of `width` numbers. A row of it is one row of the shuffle, and its sum one group."""

    def run(frames):
        total = np.zeros((size, width))
        for frame in frames:
            total += np.reshape(f(frame), (size, width))
        yield pd.DataFrame({"k": np.arange(size), "v": list(total)})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": rows["k"].iloc[:1], "v": [np.sum(rows["v"].to_list(), axis=0)]})

    parts = df.mapInPandas(run, "k int, v array<double>").groupBy("k").applyInPandas(add, "k int, v array<double>").toPandas()
    out = np.zeros((size, width))
    if len(parts):
        out[parts["k"]] = np.stack(parts["v"].to_list())
    return out if width > 1 else out[:, 0]


def fitted_rms(gram: np.ndarray, data: np.ndarray, alphas) -> np.ndarray:
    """Misfit of the damped solution at each damping, all from one decomposition of the small matrix."""
    values, vectors = np.linalg.eigh(gram)
    turned = vectors.T @ data
    return np.array([np.sqrt(np.mean((a / (np.maximum(values, 0) + a) * turned) ** 2)) for a in alphas])


def choose_strength(kernel: DataFrame, data: np.ndarray, target_rms: float, points: int = 13, low: float = 1e-3, high: float = 1e3, halvings: int = 20) -> tuple[float, dict]:
    """(strength, report): the strongest damping whose misfit is at most target_rms, by a geometric scan and bisection between its two
    neighbours. The kernel is read once; if even the weakest misses the target it is taken, and the report says so."""
    cells, _, unit = _weighted(kernel)
    gram = _summed(cells, lambda f: (lambda g: g.T @ (g / f["w"].to_numpy()[:, None] ** 2))(np.stack(f["g"].to_numpy())), len(data), len(data))
    scan = np.geomspace(low, high, points)
    rms = fitted_rms(gram, data, scan * unit)
    fine = np.flatnonzero(rms <= target_rms)
    report = {"strengths": scan.tolist(), "rms": rms.tolist(), "reached": bool(len(fine))}
    if not len(fine):
        return float(scan[0]), report
    at = int(fine[-1])
    if at == points - 1:
        return float(scan[at]), report
    a, b = np.log(scan[at]), np.log(scan[at + 1])
    for _ in range(halvings):
        middle = (a + b) / 2
        a, b = (middle, b) if fitted_rms(gram, data, [np.exp(middle) * unit])[0] <= target_rms else (a, middle)
    return float(np.exp(a)), report


def _weighted(kernel: DataFrame) -> tuple[DataFrame, int, float]:
    """(cells with depth weight w, their number, the damping of strength 1)."""
    least = kernel.agg(F.min("thickness_m").alias("t")).first().t
    weighted = kernel.withColumn("w", F.pow(F.greatest("depth_m", F.lit(0.0)) + least / 2, F.lit(-1.5)))
    top = weighted.agg(F.max("w").alias("w"), F.count("*").alias("n"), F.sum(F.aggregate("g", F.lit(0.0), lambda s, x: s + x * x)).alias("t")).first()
    return weighted.withColumn("w", F.col("w") / top.w), top.n, top.t / max(top.n, 1)


def invert(kernel: DataFrame, data: np.ndarray, strength: float = 1.0, rounds: int = 5, most: float = 1.0, noise: float | None = None) -> tuple[DataFrame, dict]:
    """(cells with chi, report). Depth-weighted, focusing inversion in data space: each round sums the small matrix G P G' over the partitions of
    cells, solves it on the driver and sends the solution back. chi stays within 0..most. P = 1 / (depth weight^2 compactness)."""
    n = len(data)
    spark = kernel.sparkSession
    cells, _, unit = _weighted(kernel)
    plain = cells.drop("g", "w")
    alpha = unit * strength
    solved, eps, report = None, None, {}
    for step in range(rounds + 1):
        sent = spark.sparkContext.broadcast((solved, eps, alpha))

        def model(f, state=sent):
            """(P, chi) of a frame's cells, from the rounds so far."""
            past, eps, _ = state.value
            g = np.stack(f["g"].to_numpy())
            p, chi = 1 / f["w"].to_numpy() ** 2, np.zeros(len(f))
            for lam, e in past or []:
                chi = np.clip(p * (g @ lam), 0, most)
                c = 1 / (chi**2 + e**2) if e else np.ones(len(f))
                p = 1 / (f["w"].to_numpy() ** 2 * np.clip(c * (e**2 if e else 1), 0.02, 1))
            return g, p, chi

        gram = _summed(cells, lambda f: (lambda g, p, _: g.T @ (g * p[:, None]))(*model(f)), n, n)
        lam = np.linalg.solve(gram + alpha * np.eye(n), data)
        past = [*(solved or []), (lam, eps)]
        probe = spark.sparkContext.broadcast((past, eps, alpha))
        fit = _summed(cells, lambda f: (lambda g, p, chi: np.r_[g.T @ chi, (chi**2).sum(), (chi > 0).sum()])(*model(f, probe)), n + 2)
        report = {"rms": float(np.sqrt(np.mean((fit[:n] - data) ** 2))), "rounds": step + 1}
        if eps is None:
            eps = 0.05 * float(np.sqrt(fit[n] / max(fit[n + 1], 1))) or 1e-6
            past[-1] = (lam, eps)
        solved = past
        if noise is not None and report["rms"] <= noise:
            break
    last = spark.sparkContext.broadcast((solved, eps, alpha))

    def run(frames):
        for f in frames:
            yield f.drop(columns=["g", "w"]).assign(chi=model(f, last)[2])

    schema = T.StructType([*plain.schema.fields, T.StructField("chi", T.DoubleType())])
    return cells.mapInPandas(run, schema), report


def resolution(kernel: DataFrame) -> DataFrame:
    """(layer, sensitivity, relative, is_weak): mean norm of the layer's kernel columns, relative to the best layer."""
    norm = F.sqrt(F.aggregate("g", F.lit(0.0), lambda s, x: s + x * x))
    layers = kernel.groupBy("layer").agg(F.avg(norm).alias("sensitivity"))
    best = layers.agg(F.max("sensitivity").alias("_m"))
    return layers.crossJoin(F.broadcast(best)).withColumn("relative", F.col("sensitivity") / F.col("_m")).withColumn("is_weak", F.col("relative") < 0.05).drop("_m")


def horizontal_slice(model: DataFrame, layer: int, low: float | None = None, high: float | None = None) -> DataFrame:
    out = model.filter(F.col("layer") == layer)
    shown = F.lit(True)
    shown = shown & (F.col("chi") >= low) if low is not None else shown
    shown = shown & (F.col("chi") <= high) if high is not None else shown
    return out.withColumn("chi", F.when(shown, F.col("chi")))


def vertical_section(model: DataFrame, path: DataFrame, cell: float) -> DataFrame:
    """(s, layer, z, chi): the column of cells under each point (s, x, y) of a path; points off the mesh have none."""
    grid = model.agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"), F.min_by("col", "x").alias("_c0"), F.min_by("row", "y").alias("_r0"))
    at = path.crossJoin(F.broadcast(grid)).withColumn("col", (F.floor((F.col("x") - F.col("_x0")) / cell + 0.5) + F.col("_c0")).cast("int")).withColumn("row", (F.floor((F.col("y") - F.col("_y0")) / cell + 0.5) + F.col("_r0")).cast("int"))
    return at.select("s", "row", "col").join(model.select("row", "col", "layer", "z", "chi"), ["row", "col"]).select("s", "layer", "z", "chi")


def box_faces(model: DataFrame, top: int = 0) -> DataFrame:
    """Cells of the model's outside: the top-most active cell (and `top` below it) of each column, and the four walls."""
    ends = model.agg(F.min("row").alias("a"), F.max("row").alias("b"), F.min("col").alias("c"), F.max("col").alias("d"))
    m = model.withColumn("_t", F.min("layer").over(Window.partitionBy("row", "col"))).crossJoin(F.broadcast(ends))
    face = F.array_compact(F.array(F.when(F.col("layer") == F.col("_t") + top, "top"), F.when(F.col("row") == F.col("a"), "south"), F.when(F.col("row") == F.col("b"), "north"), F.when(F.col("col") == F.col("c"), "west"), F.when(F.col("col") == F.col("d"), "east")))
    return m.withColumn("face", F.explode(face)).drop("_t", "a", "b", "c", "d")


def near_surface(model: DataFrame, layers: int = 2) -> DataFrame:
    """(row, col, chi): mean of each column's upper layers."""
    m = model.withColumn("_t", F.min("layer").over(Window.partitionBy("row", "col"))).filter(F.col("layer") < F.col("_t") + layers)
    return m.groupBy("row", "col").agg(F.avg("chi").alias("chi"))


def suggest_mesh(spacing: float, extent_x: float, extent_y: float, spectral_depth_m: float, most_active: int = 90_000) -> dict:
    """Cell size, depth and layers from the line spacing and the spectral depth, coarsened until the cells fit."""
    cell = max(spacing / 2, 1.0)
    depth = max(4 * spectral_depth_m, 5 * cell)
    while True:
        layers = int(np.clip(round(depth / cell / 1.5), 5, 20))
        if extent_x / cell * extent_y / cell * layers <= most_active:
            return {"cell_size_m": float(cell), "depth_extent_m": float(depth), "n_layers": layers}
        cell *= 1.1


def upsample(model: DataFrame, factor: int) -> DataFrame:
    """(x, y, z, chi) at `factor` times as many steps along rows, columns and layers: each cell sends its value to the finer points of the eight boxes
    of cells around it; a point with fewer than its eight corners is left out."""
    part = F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))
    axes = ("row", "col", "layer")
    m = model.select(*axes, "x", "y", "z", "chi")
    box = F.explode(F.array(*[F.struct(*[F.lit(v).alias(a) for v, a in zip((i, j, k), axes)]) for i in (0, 1) for j in (0, 1) for k in (0, 1)])).alias("o")
    sent = m.select("*", box).select(*[(F.col(a) - F.col(f"o.{a}")).alias(f"b_{a}") for a in axes], *[F.col(f"o.{a}").alias(f"o_{a}") for a in axes], "x", "y", "z", "chi")
    for a in axes:
        sent = sent.withColumn(f"f_{a}", part)
    weight = F.lit(1.0)
    for a in axes:
        share = F.col(f"f_{a}") / factor
        weight = weight * F.when(F.col(f"o_{a}") == 1, share).otherwise(1 - share)
    sent = sent.withColumn("w", weight)
    keys = [f"{p}_{a}" for p in "bf" for a in axes]
    return sent.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(F.col("w") * F.col(c)).alias(c) for c in ("x", "y", "z", "chi")]).filter("n = 8").select("x", "y", "z", "chi")


def resolution_advice(cell: float, spacing: float | None, nx: int, ny: int, depth_share: dict[int, float] | None = None, least: float = 0.05) -> list[str]:
    """What a reader of the model should know: cells coarser than the lines, and layers that the data hardly constrain."""
    out = []
    if spacing and cell > 1.15 * spacing:
        out.append(f"cells of {cell:.0f} m are coarser than the line spacing of {spacing:.0f} m ({nx} x {ny} observations)")
    poor = sorted(k for k, v in (depth_share or {}).items() if v < least)
    if poor:
        out.append(f"{len(poor)} layers (from layer {poor[0]}) have less than {least:.0%} of the uppermost layer's sensitivity")
    return out


MOST_OBSERVATIONS = 3000


def run_inversion(points: DataFrame, value: str, cell: float, height: float, depth: float, layers: int, inclination: float, declination: float, intensity: float, target_rms: float | None = None, strength: float = 1.0, rounds: int = 5, spacing: float | None = None) -> tuple[DataFrame, dict]:
    """(cells with chi, report): points (x, y, value) are boxed to observations, a mesh is laid below them, and the kernel, written once, is inverted.

    height: of the flight above the ground. target_rms: the damping is chosen for that misfit, else `strength` is taken. At most
    MOST_OBSERVATIONS nodes are taken, since the small matrix has their number squared; a finer cell than that is refused."""
    from ..shared import written
    from .gridding import boxing, lattice

    x0, y0, nx, ny = lattice(points, cell)
    boxed = boxing(points, value, x0, y0, cell).withColumn("x", x0 + F.col("col") * cell).withColumn("y", y0 + F.col("row") * cell)
    if (count := boxed.count()) > MOST_OBSERVATIONS:
        raise ValueError(f"{count} observations; choose cells of {cell * (count / MOST_OBSERVATIONS) ** 0.5:.0f} m or more")
    seen = boxed.select("x", "y", F.lit(float(height)).alias("z"), "value").orderBy("y", "x").toPandas()
    mesh = build_mesh(boxed.select("row", "col", "x", "y", F.lit(0.0).alias("ground")), cell, depth, layers)
    kernel = written(sensitivity(mesh, seen, cell, inclination, declination, intensity), "kernel")
    data = seen["value"].to_numpy() - float(np.median(seen["value"]))
    report: dict = {"observations": count, "nx": nx, "ny": ny}
    if target_rms is not None:
        strength, report["scan"] = choose_strength(kernel, data, target_rms)
    model, fit = invert(kernel, data, strength, rounds)
    return model, report | fit | {"strength": strength, "advice": resolution_advice(cell, spacing, nx, ny)}
