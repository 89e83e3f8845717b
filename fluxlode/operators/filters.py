"""Zero-phase filters and spectra of whole series. A series is a group (a flight, a line), so series run in parallel; each is bounded by its group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def butterworth(order: int, cutoff: float, rate: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections (b, a) of a low-pass, by the bilinear transform."""
    warped = np.tan(np.pi * cutoff / rate)
    out = []
    for k in range(order // 2):
        q = 2 * np.sin(np.pi * (2 * k + 1) / (2 * order))
        a0 = 1 + q * warped + warped**2
        out.append((warped**2 / a0 * np.array([1.0, 2.0, 1.0]), np.array([1.0, 2 * (warped**2 - 1) / a0, (1 - q * warped + warped**2) / a0])))
    if order % 2:
        out.append((np.array([warped, warped, 0]) / (1 + warped), np.array([1.0, (warped - 1) / (1 + warped), 0.0])))
    return out


def notch_section(freq: float, rate: float, quality: float = 30.0) -> list[tuple[np.ndarray, np.ndarray]]:
    w = 2 * np.pi * freq / rate
    gain = 1 / (1 + np.tan(w / quality / 2))
    return [(gain * np.array([1.0, -2 * np.cos(w), 1.0]), np.array([1.0, -2 * gain * np.cos(w), 2 * gain - 1]))]


def impulse(sections, least: float = 1e-13, most: int = 1 << 20) -> np.ndarray:
    """Impulse response of the sections in a row, until it has died away."""
    radius = max(np.abs(np.roots(a)).max() for _, a in sections)
    n = int(min(most, max(64, np.ceil(np.log(least) / np.log(min(radius, 1 - 1e-9))) * 1.5)))
    x = np.zeros(n)
    x[0] = 1
    for b, a in sections:
        y = np.zeros(n)
        d0 = d1 = 0.0
        for i, v in enumerate(x):
            o = b[0] * v + d0
            d0, d1 = b[1] * v - a[1] * o + d1, b[2] * v - a[2] * o
            y[i] = o
        x = y
    return x


def _convolve(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Causal filtering of x, as if its first value had stood there forever."""
    n = len(x) + 2 * len(h)
    size = 1 << int(np.ceil(np.log2(n)))
    long = np.r_[np.full(len(h), x[0]), x]
    return np.fft.irfft(np.fft.rfft(long, size) * np.fft.rfft(h, size), size)[len(h) : len(h) + len(x)]


def zero_phase(x: np.ndarray, sections) -> np.ndarray:
    """Forward and backward filtering with odd extension at both ends."""
    pad = min(3 * (2 * len(sections) + 1), len(x) - 1)
    long = np.r_[2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]
    h = impulse(sections)
    done = _convolve(_convolve(long, h)[::-1], h)[::-1]
    return done[pad : pad + len(x)]


def lowpass(x: np.ndarray, rate: float, cutoff: float, order: int = 4) -> np.ndarray:
    if len(x) < 13:
        return x
    if not 0 < cutoff < rate / 2:
        raise ValueError("the cutoff must lie between 0 and the Nyquist frequency")
    return zero_phase(x, butterworth(order, cutoff, rate))


def notch(x: np.ndarray, rate: float, freq: float, quality: float = 30.0) -> np.ndarray:
    return x if len(x) < 19 or freq >= rate / 2 else zero_phase(x, notch_section(freq, rate, quality))


def savitzky_golay(x: np.ndarray, width: int, order: int = 3) -> np.ndarray:
    """Value of a polynomial fitted to the window around each sample; at the ends that of the first and last window."""
    width = min(width | 1, len(x) - (len(x) + 1) % 2)
    if width <= order:
        return x
    half = width // 2
    basis = np.vander(np.arange(-half, half + 1.0), order + 1, increasing=True)
    fit = np.linalg.pinv(basis)
    out = np.convolve(x, fit[0][::-1], "same")
    for at, part in ((slice(0, half), x[:width]), (slice(len(x) - half, len(x)), x[-width:])):
        where = np.arange(-half, 0.0) if at.start == 0 else np.arange(1.0, half + 1)
        out[at] = np.vander(where, order + 1, increasing=True) @ (fit @ part)
    return out


def welch(x: np.ndarray, rate: float, size: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, power density) averaged over half-overlapping Hann windows with their means taken out."""
    size = min(size, len(x))
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    parts = [x[a : a + size] for a in range(0, len(x) - size + 1, max(1, size // 2))]
    power = np.mean([np.abs(np.fft.rfft((p - p.mean()) * w)) ** 2 for p in parts], 0) / (rate * (w * w).sum())
    power[1 : None if size % 2 else -1] *= 2
    return np.fft.rfftfreq(size, 1 / rate), power


def peaks(freq: np.ndarray, power: np.ndarray, times: float = 5.0, most: int = 8) -> list[tuple[float, float]]:
    """Local maxima over `times` the median power (as logarithms), the strongest first."""
    level = np.exp(np.median(np.log(np.maximum(power[1:], 1e-300))))
    at = [i for i in range(1, len(power) - 1) if power[i] >= power[i - 1] and power[i] >= power[i + 1] and power[i] > times * level]
    return [(float(freq[i]), float(power[i])) for i in sorted(at, key=lambda i: -power[i])[:most]]


def by_series(df: DataFrame, value: str, keys, kernel, out: str = "filtered", t: str = "t") -> DataFrame:
    """df with kernel(values, rate) of each series, ordered by time; the rate is one over the median positive step. Nulls are bridged."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values([t, *[c for c in ("point_id",) if c in f]])
        x = f[value].astype(float).interpolate(limit_direction="both").to_numpy()
        step = np.diff(f[t].to_numpy(float))
        step = step[step > 0]
        f[out] = kernel(x, 1 / np.median(step) if len(step) else 1.0) if np.isfinite(x).all() else x
        return f

    return df.groupBy(*keys).applyInPandas(run, schema)


def spectra(df: DataFrame, value: str, key: str, t: str = "t", size: int = 256) -> DataFrame:
    """(key, frequency, power, is_peak) of each series."""
    schema = T.StructType([df.schema[key], T.StructField("frequency", T.DoubleType()), T.StructField("power", T.DoubleType()), T.StructField("is_peak", T.BooleanType())])

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(t)
        step = np.diff(f[t].to_numpy(float))
        step = step[step > 0]
        if len(f) < 16 or not len(step):
            return pd.DataFrame({key: [], "frequency": [], "power": [], "is_peak": []}).astype({"is_peak": bool})
        freq, power = welch(f[value].to_numpy(float), 1 / np.median(step), size)
        top = {p[0] for p in peaks(freq, power)}
        return pd.DataFrame({key: f[key].iloc[0], "frequency": freq, "power": power, "is_peak": [x in top for x in freq]})

    return df.groupBy(key).applyInPandas(run, schema)
