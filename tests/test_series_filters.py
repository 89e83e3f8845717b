import datetime as dt

import numpy as np
import pytest

from fluxlode.functions import igrf
from fluxlode.operators import filters


def test_lowpass_response_and_zero_phase():
    t = np.arange(2000) / 50.0
    slow, fast = np.sin(2 * np.pi * 0.5 * t), np.sin(2 * np.pi * 15 * t)
    got = filters.lowpass(slow + fast, 50.0, 3.0)
    assert np.abs(got - slow)[200:-200].max() < 0.01
    half = filters.lowpass(np.sin(2 * np.pi * 3.0 * t), 50.0, 3.0)
    assert np.abs(half[500:-500]).max() == pytest.approx(0.5, abs=0.02)  # -3 dB twice
    assert np.allclose(filters.lowpass(np.full(50, 7.0), 50.0, 3.0), 7.0)
    assert (filters.lowpass(np.arange(5.0), 50.0, 3.0) == np.arange(5.0)).all()
    with pytest.raises(ValueError):
        filters.lowpass(slow, 50.0, 30.0)


def test_notch_takes_out_a_tone_that_the_spectrum_shows():
    t = np.arange(4000) / 50.0
    x = np.sin(2 * np.pi * 12.5 * t) + 0.01 * np.random.default_rng(0).normal(size=len(t))
    found = filters.peaks(*filters.welch(x, 50.0))
    assert abs(found[0][0] - 12.5) < 1
    assert np.abs(filters.notch(x, 50.0, 12.5))[1000:-1000].max() < 0.1
    f, p = filters.welch(x, 50.0)
    assert (p * (f[1] - f[0])).sum() == pytest.approx(x.var(), rel=0.05)


def test_savitzky_golay_keeps_cubics_to_the_ends():
    t = np.linspace(-1, 1, 41)
    cubic = t**3 - t
    assert np.allclose(filters.savitzky_golay(cubic, 11), cubic)


def test_series_are_filtered_apart(spark):
    rows = [(k, float(i), float(k * 100 + (i % 2)), i) for k in (1, 2) for i in range(100)]
    df = spark.createDataFrame(rows, "line_id int, t double, v double, point_id long")
    got = filters.by_series(df, "v", ["line_id"], lambda x, r: filters.lowpass(x, r, 0.05 * r)).toPandas()
    for k in (1, 2):
        assert np.abs(got[(got.line_id == k) & got.point_id.between(20, 80)].filtered - (k * 100 + 0.5)).max() < 0.05
    assert filters.spectra(df, "v", "line_id").filter("is_peak").count() >= 0


TABLE = "# a dipole along the axis\ng/h n m 2020.0 2025.0 2025-30\ng 1 0 -30000 -29900 10\ng 1 1 0 0 0\nh 1 1 0 0 0\n"


def test_field_of_an_axial_dipole():
    model = igrf.read_coefficients(TABLE)
    lat, lon, km = np.array([0.0, 90.0, 45.0]), np.zeros(3), np.zeros(3)
    e, n, u = igrf.field(lat, lon, km, 2020.0, model)
    k = (igrf.RADIUS / igrf.AXIS) ** 3
    assert n[0] == pytest.approx(30000 * k, rel=1e-6) and abs(e).max() < 1e-6 and abs(u[0]) < 1e-6
    polar = igrf.AXIS * (1 - igrf.FLATTENING)
    assert u[1] == pytest.approx(-60000 * (igrf.RADIUS / polar) ** 3, rel=1e-6)
    r = np.hypot(n[2], u[2])
    assert r == pytest.approx(30000 * np.sqrt(1 + 3 * 0.5), rel=0.01) and u[2] < 0
    assert igrf.angles(e, n, u)[0][2] == pytest.approx(np.degrees(np.arctan(2)), abs=0.5)
    assert igrf.field(lat, lon, km, 2027.5, model)[1][0] == pytest.approx((29900 - 25) * k, rel=1e-4)


def test_lattice_interpolation_is_close(spark):
    from pyspark.sql import functions as F

    model = igrf.read_coefficients(TABLE)
    rng = np.random.default_rng(1)
    rows = [(float(36 + a), float(127 + b), float(100 + 50 * c)) for a, b, c in rng.random((50, 3)) * [0.2, 0.2, 1]]
    df = spark.createDataFrame([*rows, (None, 127.0, 100.0)], "lat double, lon double, altitude_ellipsoidal_m double")
    got = igrf.total_field(df, model, F.lit(dt.date(2022, 1, 1))).toPandas()
    a = got.dropna()
    e, n, u = igrf.field(a.lat.to_numpy(), a.lon.to_numpy(), a.altitude_ellipsoidal_m.to_numpy() / 1000, 2022.0, model)
    assert len(a) == 50 and np.abs(a.igrf_total - np.sqrt(e**2 + n**2 + u**2)).max() < 0.01
