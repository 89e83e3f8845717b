"""Linear surfaces through scattered points: a Delaunay triangulation, and calibration maps of heading angles that use it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def delaunay(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Triangles (n, 3) of points by insertion: those whose circle holds the new point give way to a fan from it."""
    n = len(x)
    cx, cy, size = x.mean(), y.mean(), 20 * max(np.ptp(x), np.ptp(y), 1e-9)
    px, py = np.r_[x, cx - size, cx + size, cx], np.r_[y, cy - size, cy - size, cy + size]
    tri = np.array([[n, n + 1, n + 2]])

    def circles(t):
        ax, ay, bx, by, cx, cy = px[t[:, 0]], py[t[:, 0]], px[t[:, 1]], py[t[:, 1]], px[t[:, 2]], py[t[:, 2]]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        d = np.where(np.abs(d) < 1e-300, 1e-300, d)
        ux = ((ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by)) / d
        uy = ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / d
        return np.stack([ux, uy, (ax - ux) ** 2 + (ay - uy) ** 2], 1)

    rings = circles(tri)
    for i in np.lexsort((y, x)):
        bad = (px[i] - rings[:, 0]) ** 2 + (py[i] - rings[:, 1]) ** 2 < rings[:, 2] * (1 - 1e-12)
        if not bad.any():
            continue
        edges = np.sort(tri[bad][:, [[0, 1], [1, 2], [2, 0]]].reshape(-1, 2), 1)
        once, times = np.unique(edges, axis=0, return_counts=True)
        fan = np.column_stack([once[times == 1], np.full((times == 1).sum(), i)])
        tri, rings = np.vstack([tri[~bad], fan]), np.vstack([rings[~bad], circles(fan)])
    return tri[(tri < n).all(1)]


def linear(x, y, v, gx, gy) -> np.ndarray:
    """Plane of the triangle around each target; NaN outside the hull. Points at the same place count once, by their mean."""
    pts = pd.DataFrame({"x": x, "y": y, "v": v}).groupby(["x", "y"], as_index=False)["v"].mean()
    x, y, v = (pts[c].to_numpy(float) for c in "xyv")
    tx, ty = np.ravel(gx).astype(float), np.ravel(gy).astype(float)
    out = np.full(len(tx), np.nan)
    if len(x) >= 3:
        for a, b, c in delaunay(x, y):
            box = np.flatnonzero((tx >= min(x[a], x[b], x[c]) - 1e-9) & (tx <= max(x[a], x[b], x[c]) + 1e-9) & (ty >= min(y[a], y[b], y[c]) - 1e-9) & (ty <= max(y[a], y[b], y[c]) + 1e-9))
            d = (y[b] - y[c]) * (x[a] - x[c]) + (x[c] - x[b]) * (y[a] - y[c])
            if d == 0 or not len(box):
                continue
            u = ((y[b] - y[c]) * (tx[box] - x[c]) + (x[c] - x[b]) * (ty[box] - y[c])) / d
            w = ((y[c] - y[a]) * (tx[box] - x[c]) + (x[a] - x[c]) * (ty[box] - y[c])) / d
            ok = (u >= -1e-9) & (w >= -1e-9) & (u + w <= 1 + 1e-9)
            out[box[ok]] = u[ok] * v[a] + w[ok] * v[b] + (1 - u[ok] - w[ok]) * v[c]
    return out.reshape(np.shape(gx))


def nearest(x, y, v, gx, gy) -> np.ndarray:
    tx, ty = np.ravel(gx).astype(float), np.ravel(gy).astype(float)
    out = np.empty(len(tx))
    for a in range(0, len(tx), 1024):
        out[a : a + 1024] = np.asarray(v)[((tx[a : a + 1024, None] - x) ** 2 + (ty[a : a + 1024, None] - y) ** 2).argmin(1)]
    return out.reshape(np.shape(gx))


class HeadingMap:
    """Deviations over heading angles (theta, phi): linear between calibration points, phi going round; beyond them the nearest, which is flagged."""

    def __init__(self, theta, phi, deviation, least: int = 30):
        if len(theta) < least:
            raise ValueError(f"{len(theta)} calibration points; {least} are needed")
        self.theta, self.phi = np.tile(theta, 3), np.concatenate([np.asarray(phi) - 360, phi, np.asarray(phi) + 360])
        self.value = np.tile(np.asarray(deviation) - np.mean(deviation), 3)

    def query(self, theta, phi) -> tuple[np.ndarray, np.ndarray]:
        inside = linear(self.theta, self.phi, self.value, theta, phi)
        outside = np.isnan(inside)
        return np.where(outside, nearest(self.theta, self.phi, self.value, theta, phi), inside), outside

    def correct(self, df: DataFrame, value: str, out: str = "compensated") -> DataFrame:
        """df (theta, phi) with value less the map's deviation, and heading_extrapolated; the map goes along with the function."""

        def run(frames):
            for f in frames:
                d, flag = self.query(f["theta"].to_numpy(float), f["phi"].to_numpy(float))
                yield f.assign(**{out: f[value] - d, "heading_extrapolated": flag})

        from pyspark.sql import types as T

        return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType()), T.StructField("heading_extrapolated", T.BooleanType())]))


def cross_validate(theta, phi, deviation, folds: int = 5, seed: int = 0) -> tuple[float, float]:
    """(standard deviation, peak to peak) of the deviations left at points that the map was not fitted to."""
    order = np.random.default_rng(seed).permutation(len(theta))
    left = np.empty(len(theta))
    theta, phi, deviation = (np.asarray(a, float) for a in (theta, phi, deviation))
    for part in np.array_split(order, folds):
        rest = np.setdiff1d(order, part)
        fit = HeadingMap(theta[rest], phi[rest], deviation[rest], 3)
        left[part] = deviation[part] - deviation[rest].mean() - fit.query(theta[part], phi[part])[0]
    return float(left.std()), float(np.ptp(left))


def line_resolution(lines: dict[int, tuple[np.ndarray, np.ndarray]], step: float = 5.0, short: float = 40.0, long: float = 600.0, overlap: float = 800.0) -> list[tuple[int, float]]:
    """(line, unresolved share): in neighbouring triples of lines {id: (along, value)}, the share of the middle line's variance in the band between the
    two wavelengths that the mean of its neighbours lacks."""
    out, ids = [], sorted(lines)
    for a, m, b in zip(ids, ids[1:], ids[2:]):
        lo, hi = max(lines[i][0].min() for i in (a, m, b)), min(lines[i][0].max() for i in (a, m, b))
        if hi - lo < overlap:
            continue
        s = np.arange(lo, hi, step)
        va, vm, vb = (np.interp(s, *(np.asarray(x)[np.argsort(lines[i][0])] for x in lines[i])) for i in (a, m, b))
        k = np.fft.rfftfreq(len(s), step)
        band = (k >= 1 / long) & (k <= 1 / short)
        take = lambda v: np.fft.irfft(np.where(band, np.fft.rfft(v - v.mean()), 0), len(s))  # noqa: B023, E731
        middle, guess = take(vm), take((va + vb) / 2)
        if middle.var() > 0:
            out.append((m, float(min(1.0, (middle - guess).var() / middle.var()))))
    return out
