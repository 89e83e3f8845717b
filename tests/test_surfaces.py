import numpy as np
import pytest

from fluxlode.operators import surfaces


def test_triangulation_is_delaunay_and_planes_are_exact():
    rng = np.random.default_rng(0)
    x, y = rng.random(80), rng.random(80)
    tri = surfaces.delaunay(x, y)
    for t in tri:
        m = np.column_stack([2 * x[t], 2 * y[t], np.ones(3)])
        cx, cy, k = np.linalg.solve(m, x[t] ** 2 + y[t] ** 2)
        inside = (x - cx) ** 2 + (y - cy) ** 2 < (k + cx**2 + cy**2) * (1 - 1e-9)
        assert not np.delete(inside, t).any()
    gx, gy = np.meshgrid(np.linspace(0.3, 0.7, 9), np.linspace(0.3, 0.7, 9))
    assert np.allclose(surfaces.linear(x, y, 3 * x - 2 * y + 1, gx, gy), 3 * gx - 2 * gy + 1)
    assert np.isnan(surfaces.linear(x, y, x, np.array([5.0]), np.array([5.0])))[0]


def test_heading_map_goes_round_and_flags_what_it_has_not_seen(spark):
    rng = np.random.default_rng(1)
    theta, phi = rng.uniform(20, 60, 300), rng.uniform(0, 360, 300)
    dev = 2 * np.cos(np.radians(phi)) + 0.05 * theta
    fit = surfaces.HeadingMap(theta, phi, dev)
    got, out = fit.query(np.array([40.0, 40.0, 89.0]), np.array([0.0, 359.9, 10.0]))
    assert abs(got[0] - got[1]) < 0.2 and list(out) == [False, False, True]
    assert surfaces.cross_validate(theta, phi, dev)[0] < 0.3 * dev.std()
    with pytest.raises(ValueError):
        surfaces.HeadingMap(theta[:5], phi[:5], dev[:5])
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(theta[:50], phi[:50], dev[:50])], "theta double, phi double, mag double")
    left = fit.correct(df, "mag").toPandas().compensated
    assert left.std() < 0.2


def test_line_resolution():
    s = np.arange(0, 1500, 5.0)
    same = {i: (s, np.sin(2 * np.pi * s / 200)) for i in range(3)}
    other = {**same, 1: (s, np.cos(2 * np.pi * s / 200))}
    assert surfaces.line_resolution(same)[0][1] < 0.01 and surfaces.line_resolution(other)[0][1] > 0.9
    assert surfaces.line_resolution({i: (s[:50], s[:50]) for i in range(3)}) == []
