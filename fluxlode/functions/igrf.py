"""Main-field models of spherical harmonics from a published coefficients file, which is a parameter and no part of this repository.

The file is the plain-text table of Gauss coefficients: rows `g|h n m value...`, a header row with the epochs, and a last column of yearly change."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS = 6371.2
AXIS, FLATTENING = 6378.137, 1 / 298.257223563


def read_coefficients(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(epochs, g, h): arrays (epoch, n, m); the yearly change becomes an epoch five years after the last."""
    rows = [r.split() for r in text.splitlines() if r.strip() and not r.startswith("#")]
    head = next(r for r in rows if r[0].lower() in ("g/h", "gh"))
    epochs = [float(x) for x in head[3:] if x.replace(".", "").isdigit()]
    data = [r for r in rows if r[0] in ("g", "h")]
    top = max(int(r[1]) for r in data)
    g, h = np.zeros((len(epochs) + 1, top + 1, top + 1)), np.zeros((len(epochs) + 1, top + 1, top + 1))
    for r in data:
        v = [float(x) for x in r[3:]]
        v = v[: len(epochs)] + [v[len(epochs) - 1] + 5 * (v[len(epochs)] if len(v) > len(epochs) else 0.0)]
        (g if r[0] == "g" else h)[:, int(r[1]), int(r[2])] = v
    return np.array([*epochs, epochs[-1] + 5]), g, h


def field(lat: np.ndarray, lon: np.ndarray, km: np.ndarray, year: float, model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(east, north, up) in nT at geodetic coordinates."""
    epochs, gs, hs = model
    year = float(np.clip(year, epochs[0], epochs[-1]))
    i = int(np.clip(np.searchsorted(epochs, year, "right") - 1, 0, len(epochs) - 2))
    w = (year - epochs[i]) / (epochs[i + 1] - epochs[i])
    g, h = gs[i] * (1 - w) + gs[i + 1] * w, hs[i] * (1 - w) + hs[i + 1] * w
    phi, lam = np.radians(lat), np.radians(lon)
    e2 = FLATTENING * (2 - FLATTENING)
    n0 = AXIS / np.sqrt(1 - e2 * np.sin(phi) ** 2)
    rho, z = (n0 + km) * np.cos(phi), (n0 * (1 - e2) + km) * np.sin(phi)
    r = np.hypot(rho, z)
    ct, st = z / r, np.maximum(rho / r, 1e-10)
    top = g.shape[0] - 1
    p, dp = np.zeros((top + 1, top + 1, *lat.shape)), np.zeros((top + 1, top + 1, *lat.shape))
    p[0, 0] = 1
    for n in range(1, top + 1):  # Schmidt quasi-normalised functions and their derivatives in colatitude
        for m in range(n + 1):
            if m == n:
                k = np.sqrt((2 * n - 1) / (2 * n)) if n > 1 else 1.0
                p[n, n], dp[n, n] = k * st * p[n - 1, n - 1], k * (st * dp[n - 1, n - 1] + ct * p[n - 1, n - 1])
            else:
                a, b = (2 * n - 1) / np.sqrt(n * n - m * m), np.sqrt(((n - 1) ** 2 - m * m) / (n * n - m * m)) if n > 1 else 0.0
                older, dolder = (p[n - 2, m], dp[n - 2, m]) if n > 1 else (0.0, 0.0)
                p[n, m], dp[n, m] = a * ct * p[n - 1, m] - b * older, a * (ct * dp[n - 1, m] - st * p[n - 1, m]) - b * dolder
    br, bt, bp = np.zeros(lat.shape), np.zeros(lat.shape), np.zeros(lat.shape)
    for n in range(1, top + 1):
        k = (RADIUS / r) ** (n + 2)
        for m in range(n + 1):
            c, s = g[n, m] * np.cos(m * lam) + h[n, m] * np.sin(m * lam), g[n, m] * np.sin(m * lam) - h[n, m] * np.cos(m * lam)
            br += k * (n + 1) * c * p[n, m]
            bt -= k * c * dp[n, m]
            bp += k * m * s * p[n, m] / st
    tilt = phi - np.arctan2(ct, st)  # between geodetic and geocentric vertical
    north, up = -bt, br
    return bp, north * np.cos(tilt) - up * np.sin(tilt), up * np.cos(tilt) + north * np.sin(tilt)


def angles(east, north, up) -> tuple[np.ndarray, np.ndarray]:
    """(inclination, declination) in degrees."""
    return np.degrees(np.arctan2(-up, np.hypot(east, north))), np.degrees(np.arctan2(east, north))


def total_field(points: DataFrame, model, day: Column, shape: tuple[int, int, int] = (10, 10, 5)) -> DataFrame:
    """points (lat, lon, altitude_ellipsoidal_m) with igrf_total: per UTC day the model on a lattice over the day's bounds, and between its nodes
    trilinear components. Bounds are a row a day; the lattice of each day, some hundred numbers, is joined as arrays."""
    spark = points.sparkSession
    p = points.withColumn("_day", day)
    b = p.groupBy("_day").agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon", "altitude_ellipsoidal_m") for n, f in (("lo", F.min), ("hi", F.max))]).filter("lo_lat is not null and lo_lon is not null and lo_altitude_ellipsoidal_m is not null").collect()
    rows = []
    for r in b:
        axes = []
        for c, n, least, scale in (("lat", shape[0], 0.01, 1.0), ("lon", shape[1], 0.01, 1.0), ("altitude_ellipsoidal_m", shape[2], 0.05, 1e-3)):
            lo, hi = r[f"lo_{c}"] * scale, r[f"hi_{c}"] * scale
            grow = max(0.0, least - (hi - lo)) / 2
            axes.append(np.linspace(lo - grow, hi + grow, n))
        la, lo, al = np.meshgrid(*axes, indexing="ij")
        year = r._day.year + (r._day.timetuple().tm_yday - 1) / 365.25
        e, n, u = field(la, lo, al, year, model)
        rows.append((r._day, *[float(v) for a in axes for v in (a[0], a[1] - a[0])], *[x.ravel().tolist() for x in (e, n, u)]))
    names = "a0 double, da double, b0 double, db double, c0 double, dc double, e array<double>, n array<double>, u array<double>"
    lattice = spark.createDataFrame(rows, f"_day date, {names}")
    have = p.join(F.broadcast(lattice), "_day", "left")
    i, j, k = ((F.col(c) * s - F.col(o)) / F.col(d) for c, s, o, d in (("lat", 1.0, "a0", "da"), ("lon", 1.0, "b0", "db"), ("altitude_ellipsoidal_m", 1e-3, "c0", "dc")))
    low = [F.greatest(F.lit(0), F.least(F.floor(v).cast("int"), F.lit(n - 2))) for v, n in zip((i, j, k), shape)]
    frac = [v - w for v, w in zip((i, j, k), low)]

    def at(name: str) -> Column:
        total = F.lit(0.0)
        for a in (0, 1):
            for b_ in (0, 1):
                for c in (0, 1):
                    weight = (frac[0] if a else 1 - frac[0]) * (frac[1] if b_ else 1 - frac[1]) * (frac[2] if c else 1 - frac[2])
                    total = total + weight * F.get(name, ((low[0] + a) * shape[1] + low[1] + b_) * shape[2] + low[2] + c)
        return total

    return have.withColumn("igrf_total", F.sqrt(at("e") ** 2 + at("n") ** 2 + at("u") ** 2)).select(*points.columns, "igrf_total")
