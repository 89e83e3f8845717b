import os
import random

import pytest
from pyspark.sql import functions as F

from fluxlode.operators import gridding, spatial
from fluxlode.plans import surfaces
from fluxlode.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"


def test_pairs_and_nearest_take_every_point(spark):
    rows = [(i, float(i * i % 97), float(i * 7 % 53)) for i in range(60)] + [(100, 5000.0, -3000.0)]
    a = spark.createDataFrame(rows, "point_id long, x double, y double")
    b = a.selectExpr("point_id as other", "x as x2", "y as y2")
    dist = lambda p, q: ((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) ** 0.5
    got = {r.point_id: (r.other, r.distance_m) for r in spatial.nearest(a, "point_id", b, "other", 3.0, apart=True).collect()}
    for p in rows:  # however far, ties to the smaller id
        d, other = min((dist(p, q), q[0]) for q in rows if q[0] != p[0])
        assert got[p[0]] == (other, pytest.approx(d))
    near = {r.point_id: r.other for r in spatial.nearest(a, "point_id", b, "other", 3.0, widen=False, apart=True).collect()}
    assert near[100] is None


def test_line_gap_reaches_the_two_nearest_lines(spark):
    cells = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 900.0, 40.0)], "row int, col int, x double, y double")
    points = spark.createDataFrame([(k, 100.0 * k, 5.0 * j) for k in range(3) for j in range(10)], "line_id int, x2 double, y2 double")
    got = {r.col: r.gap_m for r in spatial.line_gap(cells, points, 10.0).collect()}
    assert got[0] == pytest.approx(100) and got[1] == pytest.approx(700 + 800)
    alone = spatial.line_gap(cells, points.filter("line_id = 0"), 10.0).collect()
    assert [r.gap_m for r in alone] == [None, None]


def test_queries_take_every_point(spark):
    if not os.path.isdir(DIR):
        pytest.skip("no test tables here")
    ids = {r.point_id for r in surfaces.view(spark, DIR, "survey").collect()}
    assert {r.point_id for r in QUERIES["h_nearest"](spark, DIR).collect()} == ids
    assert {r.id for r in QUERIES["h_components"](spark, DIR).collect()} == ids


def test_rows_dealt_to_nine_cells_are_not_broadcast(spark):
    a = spark.range(50).select("id", (F.col("id") * 3.0).alias("x"), F.lit(0.0).alias("y"), (F.col("id") % 2).alias("k"))
    b = a.select(F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), "k")
    assert "Broadcast" not in spatial.within(a, b.drop("k"), 6.0)._jdf.queryExecution().executedPlan().toString()
    pairs = spatial.within(a, b, 6.0, on=("k",))
    assert {(r.id, r.id2) for r in pairs.collect()} == {(i, j) for i in range(50) for j in (i - 2, i, i + 2) if 0 <= j < 50}


@pytest.mark.parametrize("name", ["h_line_gap", "i_nearest_grid"])
def test_long_grids_have_no_most_cells(spark, monkeypatch, name):
    if not os.path.isdir(DIR):
        pytest.skip("no test tables here")
    monkeypatch.setattr(gridding, "MOST_CELLS", 10)
    got = QUERIES[name](spark, DIR).select("row", "col").collect()
    assert len(set(got)) == len(got) == (max(r.row for r in got) + 1) * (max(r.col for r in got) + 1) > 10


def test_line_gap_far_from_lines_of_any_shape(spark):
    rng = random.Random(3)
    points = [(k, rng.uniform(-9000, 9000) * k, rng.gauss(0, 40) + 800 * k) for k in range(1, 6) for _ in range(30)]
    cells = [(i, j, 700.0 * i - 20000, 500.0 * j - 3000) for i in range(60) for j in range(12)]
    got = spatial.line_gap(spark.createDataFrame(cells, "row int, col int, x double, y double"), spark.createDataFrame(points, "line_id int, x2 double, y2 double"), 10.0).collect()
    assert len(got) == len(cells)
    found = {(r.row, r.col): r.gap_m for r in got}
    for i, j, x, y in cells:
        near = sorted(min(((x - a) ** 2 + (y - b) ** 2) ** 0.5 for k, a, b in points if k == line) for line in range(1, 6))
        assert found[i, j] == pytest.approx(near[0] + near[1])
