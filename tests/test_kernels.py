"""Kernels against known answers and plain computations."""

import numpy as np
import pandas as pd
import pytest

from fluxlode.operators import gridding, interpretation, inversion, leveling, lines, spatial, stats
from fluxlode.operators import transforms as tf


def sphere(depth=80.0, cell=10.0):
    y, x = np.mgrid[:61, :101] * cell
    r = np.sqrt((x - 500) ** 2 + (y - 300) ** 2 + depth**2)
    return 50000 + 5e7 / r**3


def test_distance_transform_is_exact():
    mask = np.random.default_rng(0).random((23, 31)) < 0.05
    d, source = tf.distance_to(mask)
    at = np.argwhere(mask)
    y, x = np.mgrid[:23, :31]
    plain = ((y[..., None] - at[:, 0]) ** 2 + (x[..., None] - at[:, 1]) ** 2).min(-1)
    assert (d == plain).all() and mask.ravel()[source].all()


def test_filters_of_plane_waves():
    y, x = np.mgrid[:128, :128] * 10.0
    k = 2 * np.pi / 160
    wave = np.sin(k * x)
    mid = np.s_[48:80, 48:80]
    assert np.allclose(tf.vertical_derivative(wave, 10)[mid], k * wave[mid], atol=0.05 * k)
    assert np.allclose(tf.horizontal_derivative(wave, 10, east=1)[mid], k * np.cos(k * x)[mid], atol=0.05 * k)
    assert np.allclose(tf.horizontal_derivative(wave, 10, north=1)[mid], 0, atol=0.05 * k)
    assert np.allclose(tf.upward_continuation(wave, 10, 30)[mid], np.exp(-30 * k) * wave[mid], atol=0.03)
    with pytest.raises(ValueError):
        tf.upward_continuation(wave, 10, 0)


def test_transforms_keep_gaps_and_rtp_of_a_vertical_field_is_the_identity():
    g = sphere()
    g[5:9, 5:9] = np.nan
    for name in tf.BY_NAME:
        out = tf.transform(g, 10.0, name, inclination=60.0, declination=5.0, height=20.0, azimuth=0.0, spacing=50.0)
        assert (np.isfinite(out) == np.isfinite(g)).all(), name
    same = tf.reduction_to_pole(sphere(), 10.0, 90.0, 0.0)
    assert np.abs(same - sphere())[20:40, 30:70].max() < 1.0


def test_continuation_fills_gaps_and_leaves_known_cells():
    g = sphere(120.0)
    hole = g.copy()
    hole[20:22, 40:42] = np.nan
    filled = tf.continuation_fill(hole)
    known = np.isfinite(hole)
    assert (filled[known] == hole[known]).all()
    assert np.abs(filled - g)[~known].max() < 0.1 * np.ptp(g)


def test_euler_finds_sources():
    got = interpretation.euler_solutions(sphere(), 10.0, index=3.0, window_m=150.0, most_error=50.0)
    assert abs(got.depth.median() - 80) < 20 and abs(got.base.median() - 50000) < 5000
    y, x = np.mgrid[:61, :101] * 10.0
    rho2 = (x - 500) ** 2 + (y - 300) ** 2
    dipole = 50000 + 5e7 * (2 * 80**2 - rho2) / np.sqrt(rho2 + 80**2) ** 5  # harmonic, so the spectral derivative is exact
    got = interpretation.euler_solutions(dipole, 10.0, index=3.0, window_m=150.0)
    near = got[np.hypot(got.x - 500, got.y - 300) < 40]
    assert abs(near.depth.median() - 80) < 8


def test_dipole_fit_and_candidates():
    rng = np.random.default_rng(1)
    px, py = rng.uniform(0, 20, 400), rng.uniform(0, 20, 400)
    i, d = np.radians(55), np.radians(-8)
    direction = np.array([np.cos(i) * np.sin(d), np.cos(i) * np.cos(d), np.sin(i)])
    v = interpretation.dipole_field(9.0, 11.0, 2.0, direction, 1.5, px, py) + 3 + rng.normal(0, 0.2, 400)
    got = interpretation.fit_dipole(px, py, v, direction, 10.0, 10.0, 3.0, 10.0, 5.0)
    assert abs(got["x"] - 9) < 0.2 and abs(got["y"] - 11) < 0.2 and abs(got["depth"] - 2) < 0.3 and abs(got["moment"] - 1.5) < 0.3
    y, x = np.mgrid[:41, :41] * 0.5
    grid = interpretation.dipole_field(10.0, 10.0, 2.0, direction, 1.5, x, y)
    assert len(interpretation.candidates(grid, 0.5, 5.0, 0.5, 8.0)) >= 1


def test_targets_are_detected(spark):
    i, d = np.radians(55), np.radians(-8)
    direction = np.array([np.cos(i) * np.sin(d), np.cos(i) * np.cos(d), np.sin(i)])
    y, x = np.mgrid[:61, :61] * 0.5
    v = interpretation.dipole_field(15.0, 15.0, 1.5, direction, 2.0, x, y) + np.random.default_rng(2).normal(0, 0.3, x.shape)
    pts = spark.createDataFrame(pd.DataFrame({"x": x.ravel(), "y": y.ravel(), "value": v.ravel()}))
    got = interpretation.detect_targets(pts, v, 0.0, 0.0, 0.5, 55.0, -8.0).collect()
    assert got and np.hypot(got[0].x - 15, got[0].y - 15) < 0.5
    assert interpretation.detect_targets(pts, np.zeros((30, 30)) + np.random.default_rng(1).normal(0, 1e-9, (30, 30)), 0.0, 0.0, 0.5, 55.0, -8.0, k=50.0).collect() == []


def test_minimum_curvature_and_spline_pass_through_data():
    y, x = np.mgrid[:30, :30] * 1.0
    plane = 2 * x - y + 5
    holes = np.where(np.random.default_rng(3).random(plane.shape) < 0.2, plane, np.nan)
    got = gridding.minimum_curvature(holes)
    known = np.isfinite(holes)
    assert (got[known] == plane[known]).all() and np.abs(got - plane)[3:-3, 3:-3].max() < 3
    at = np.argwhere(known)[:80]
    s = gridding.biharmonic_spline(at[:, 1] * 1.0, at[:, 0] * 1.0, plane[at[:, 0], at[:, 1]], x, y, damping=1e-12)
    assert np.abs(s[at[:, 0], at[:, 1]] - plane[at[:, 0], at[:, 1]]).max() < 0.5
    assert gridding.contour_levels(3, 11, 5) == [5.0, 10.0] and len(gridding.contour_levels(0, 1, None, 4)) == 4


def test_contours_lie_on_the_level(spark):
    grid = gridding.nodes(spark, 0.0, 0.0, 12, 9, 10.0).withColumn("value", __import__("pyspark").sql.functions.expr("easting + 2 * northing"))
    got = gridding.contour_segments(grid, [75.0]).collect()
    assert got and all(abs(r.ax + 2 * r.ay - 75) < 1e-9 and abs(r.bx + 2 * r.by - 75) < 1e-9 for r in got)


def test_running_trend_keeps_a_quadratic_and_ignores_an_outlier():
    t = np.arange(30.0)
    v = 0.1 * t**2 - t
    v[12] += 50
    got = leveling.running_trend(v, 9)
    assert abs(got[12] - (0.1 * 144 - 12)) < 8 and np.abs(got[20:] - v[20:]).max() < 1e-6


def serpentine(spark, shifts, ties=False):
    rows, t, pid = [], 0.0, 0
    for line, shift in enumerate(shifts):
        for s in range(201):
            y = s * 2.0 if line % 2 == 0 else 400 - s * 2.0
            x = line * 50.0
            rows.append((pid, t, x, y, 50 + 0.02 * x + 0.01 * y + shift, line, -1, float(s * 2), line // 3))
            t, pid = t + 1, pid + 1
        t += 60
    if ties:
        for k, y in enumerate((100.0, 200.0, 300.0)):
            for s in range(101):
                rows.append((pid, t, s * 2.0, y, 50 + 0.04 * s + 0.01 * y, -1, k, float(s * 2), 9))
                t, pid = t + 1, pid + 1
    return spark.createDataFrame(rows, "point_id long, t double, x double, y double, value double, line_id int, tie_line_id int, s double, source_file_index int")


def test_crossovers_recover_shifts(spark):
    shifts = [5.0, -3.0, 8.0, 0.0, -6.0]
    df = serpentine(spark, shifts, ties=True)
    got, _ = leveling.crossover_shifts(leveling.crossings(df, "value", 3.0))
    found = {r.line_id: r["shift"] for r in got.collect()}
    assert np.allclose([found[i] for i in range(5)], np.array(shifts) - np.mean(shifts), atol=0.2)
    level = leveling.apply_shifts(df.filter("line_id >= 0"), got, "value").groupBy("line_id").agg({"leveled": "avg"}).toPandas().sort_values("line_id").iloc[:, 1]
    assert np.abs(np.diff(level) - 1.0).max() < 0.3


def test_heading_offset_is_recovered(spark):
    df = serpentine(spark, [2.0 if i % 2 else -2.0 for i in range(9)])
    df = df.selectExpr("*", "CASE WHEN line_id % 2 = 0 THEN 'A' ELSE 'B' END AS group")
    got = leveling.local_plane_offset(df, "value", 50.0).first()
    assert abs(got.offset - 4.0) < 0.3 and got.n > 0


def test_statistical_levelling_needs_lines_and_finds_a_shift(spark):
    assert leveling.statistical_shifts(serpentine(spark, [0.0] * 5), "value", 90.0, 50.0).count() == 0
    shifts = [0.0] * 15
    shifts[7] = 10.0
    got = {r.line_id: r["shift"] for r in leveling.statistical_shifts(serpentine(spark, shifts), "value", 90.0, 50.0).collect()}
    assert max(got, key=lambda k: got[k]) == 7 and got[7] > 5


def test_lines_are_bridged_and_turns_left_out(spark):
    rows, pid = [], 0
    for t in range(400):
        on = not 180 <= t < 184
        rows.append((pid, float(t), 0.0 if on else 5.0, t * 3.0, 0))
        pid += 1
    for t in range(400, 440):
        rows.append((pid, float(t), (t - 399) * 3.0, 1197.0, 0))
        pid += 1
    df = spark.createDataFrame(rows, "point_id long, t double, x double, y double, source_file_index int")
    got = lines.detect_lines(df).toPandas().sort_values("t")
    assert set(got[got.line_id >= 0].line_id) == {0}
    assert (got[(got.t > 20) & (got.t < 380)].line_id == 0).all() and (got[got.t > 410].line_id == -1).all()
    assert (got[got.t < 3].reason == "takeoff_ramp").all()


def test_components_of_a_long_path(spark):
    nodes = spark.createDataFrame([(i,) for i in range(40)] + [(99,)], "id long")
    links = spark.createDataFrame([(i, i + 1) for i in range(39)], "a long, b long")
    got = {r.id: r.component for r in spatial.components(nodes, links).collect()}
    assert set(got[i] for i in range(40)) == {0} and got[99] == 99


def test_hull_densify_and_segments(spark):
    rng = np.random.default_rng(5)
    pts = spark.createDataFrame([(float(a), float(b)) for a, b in rng.uniform(1, 9, (200, 2))] + [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], "x double, y double")
    assert set(spatial.convex_hull(pts)) == {(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)}
    path = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 10.0, 0.0), (1, 2, 10.0, 5.0)], "path_id int, seq int, x double, y double")
    assert [(r.s, r.x, r.y) for r in spatial.densify(path, 5.0).orderBy("s").collect()] == [(0.0, 0.0, 0.0), (5.0, 5.0, 0.0), (10.0, 10.0, 0.0), (15.0, 10.0, 5.0)]
    seg = spark.createDataFrame([(0.0, 0.0, 10.0, 0.0)], "ax double, ay double, bx double, by double")
    near = spatial.near_segments(spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 3.0), (3, 11.0, 0.0)], "id int, x double, y double"), "id", seg, 1.5)
    assert {r.id: r.near for r in near.collect()} == {1: True, 2: False, 3: True}


def test_inversion_finds_a_block(spark):
    cols = spark.createDataFrame([(r, c, c * 20.0, r * 20.0, 50.0) for r in range(9) for c in range(9)], "row int, col int, x double, y double, ground double")
    mesh = inversion.build_mesh(cols, 20.0, 100.0, 4)
    y, x = np.mgrid[:12, :12] * 14.0
    obs = pd.DataFrame({"x": x.ravel(), "y": y.ravel(), "z": 60.0})
    g = inversion.sensitivity(mesh, obs, 20.0, 55.0, -8.0, 50000.0).cache()
    block = g.filter("row between 4 and 5 and col between 4 and 5 and layer = 1")
    data = np.sum([np.array(r.g) for r in block.select("g").collect()], 0) * 0.05
    model, report = inversion.invert(g, data, strength=0.01, rounds=3)
    got = model.toPandas()
    top = got.nlargest(8, "chi")
    assert report["rms"] < 0.3 * np.abs(data).max() and abs((top.row * top.chi).sum() / top.chi.sum() - 4.5) < 1 and abs((top.col * top.chi).sum() / top.chi.sum() - 4.5) < 1
    assert got.chi.between(0, 1).all()
    assert inversion.resolution(g).count() == 4
    assert {r.face for r in inversion.box_faces(model).select("face").distinct().collect()} == {"top", "north", "south", "east", "west"}
    path = spark.createDataFrame([(0.0, 80.0, 80.0), (1.0, 5000.0, 0.0)], "s double, x double, y double")
    assert inversion.vertical_section(model, path, 20.0).count() == 4
    assert inversion.horizontal_slice(model, 1, low=2.0).filter("chi is not null").count() == 0


def test_certificate():
    assert stats.certificate({})["overall"] == "not_evaluated"
    assert stats.certificate({"sigma_nt": 1.0})["overall"] == "pass"
    assert stats.certificate({"sigma_nt": 1.0, "gap_pct": 50.0})["overall"] == "fail"


def test_nearest_pairs_see_the_heading_offset(spark):
    df = serpentine(spark, [2.0 if i % 2 else -2.0 for i in range(9)]).selectExpr("*", "CASE WHEN line_id % 2 = 0 THEN 'A' ELSE 'B' END AS group")
    got = leveling.nearest_pair_offset(df, "value", 90.0, 50.0).first()
    assert abs(got.offset - 4.0) < 1.1 and got.n > 100


def test_first_order_crossovers(spark):
    rows = [(1, k, float(s), 3.0 + 0.01 * s) for k, s in enumerate((0, 100, 200, 300))] + [(2, 0, 0.0, 5.0)]
    cross = spark.createDataFrame(rows, "line_id int, tie_id int, s double, delta double")
    ties = spark.createDataFrame([(0, 0.0)], "tie_id int, shift double")
    got = {r.line_id: (r["shift"], r.slope) for r in leveling.crossover_lines(cross, ties).collect()}
    assert got[1] == pytest.approx((3.0, 0.01)) and got[2] == (5.0, 0.0)


def test_outline_surrounds_the_points(spark):
    pts = spark.createDataFrame([(float(x), float(y)) for x in range(0, 100, 5) for y in range(0, 50, 5)], "x double, y double")
    edge, area = spatial.survey_outline(pts, 10.0)
    got = edge.collect()
    assert min(r.ax for r in got) < -5 and max(r.ax for r in got) > 100 and 95 * 45 < area.first().area_m2 < 125 * 75
    ends = [(round(x, 6), round(y, 6)) for r in got for x, y in ((r.ax, r.ay), (r.bx, r.by))]
    assert all(ends.count(e) == 2 for e in set(ends))  # closed


def test_upsampling_is_exact_for_planes(spark):
    rows = [(r, c, k, c * 10.0, r * 10.0, -k * 5.0, 2.0 * c - r + k) for r in range(3) for c in range(3) for k in range(2)]
    model = spark.createDataFrame(rows, "row int, col int, layer int, x double, y double, z double, chi double")
    got = inversion.upsample(model, 4).collect()
    assert len(got) == 2 * 2 * 1 * 64 and all(abs(p.chi - (0.2 * p.x - 0.1 * p.y - 0.2 * p.z)) < 1e-9 for p in got)
