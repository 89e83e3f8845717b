import pytest
from pyspark.sql import functions as F

from fluxlode.functions import measure
from fluxlode.operators import editing, lines, series, spatial, timejoin
from fluxlode.process import Settings, process, report
from fluxlode.sources import repair


def points(spark):
    rows = [(i, float(i), 36.0 + i / 1000, 127.0, 0 if 2 <= i < 8 else -1, "takeoff_ramp" if i < 2 else None, 100.0 + i, float(i), 0.0, -1) for i in range(10)]
    return spark.createDataFrame(rows, "point_id long, t double, lat double, lon double, line_id int, reason string, tmi double, x double, y double, tie_line_id int")


def test_exclusion_protects_ramps_and_the_last_edit_wins(spark):
    p = points(spark)
    o = editing.set_exclusion(p, None, "include", polygons=[[(35.9, 126.9), (36.1, 126.9), (36.1, 127.1), (35.9, 127.1)], [(0, 0)]])
    o = editing.set_exclusion(p, o, "exclude", ids=[3, 4])
    state = {r.point_id: r.excluded for r in editing.exclusion_state(p, o).collect()}
    assert state == {i: i < 2 or i in (3, 4) for i in range(10)}
    assert {r.point_id for r in editing.exclusion_state(p).filter("excluded").collect()} == {0, 1, 8, 9}
    ramps = editing.set_exclusion(p, None, "include", include_ramp=True, ids=[0])
    assert not {r.point_id: r.excluded for r in editing.exclusion_state(p, ramps).collect()}[0]
    listed = editing.point_list(p, "tmi", o)
    assert {r.point_id for r in editing.without_hidden_ramps(listed).collect()} == set(range(2, 10))
    assert [r.point_id for r in editing.in_rectangle(listed, (5, 1), (2.5, -1), "include").orderBy("point_id").collect()] == [3, 4]
    with pytest.raises(ValueError):
        editing.set_exclusion(p, None, "exclude", polygons=[[(0, 0), (1, 1)]])
    with pytest.raises(ValueError):
        editing.set_exclusion(p, None, "drop", ids=[1])


def test_smoothing_is_always_made_from_the_untouched_points(spark):
    p = points(spark).withColumn("line_id", F.lit(0)).withColumn("tmi", F.when(F.col("point_id") == 5, 900.0).otherwise(F.col("tmi")))
    once = editing.add_smoothing(p, None, ids=[5])
    twice = editing.add_smoothing(p, once, ids=[5, 6])
    got = {r.point_id: r.tmi for r in editing.smoothed(p, twice).collect()}
    assert 100 < got[5] < 110 and 100 < got[6] < 110 and got[4] == 104
    assert sorted(r.point_id for r in twice.collect()) == [5, 6]
    assert editing.smoothed(p, None) is p


def test_measures(spark):
    one = spark.createDataFrame([(1, [(36.0, 127.0), (36.0, 127.01), (36.01, 127.01), (36.01, 127.0)]), (2, [(36.0, 127.0)]), (3, [])], "id int, p array<struct<lat:double,lon:double>>")
    got = {r.id: r for r in one.select("id", measure.path_length_m(F.col("p")).alias("l"), measure.polygon_area_m2(F.col("p")).alias("a")).collect()}
    assert got[1].l == pytest.approx(899.6 + 1111.95 + 899.5, rel=1e-3) and got[1].a == pytest.approx(1111.95 * 899.5, rel=1e-3)
    assert got[2].l == got[2].a == got[3].l == got[3].a == 0
    v = spark.createDataFrame([(x,) for x in (5.0, 10.0, 15.0, 20.0, 40.0, 99.0, None)], "v double")
    at = [r[0] for r in v.select(measure.scale_position(F.col("v"), 0, 1, [10.0, 20.0, 20.0, 60.0])).collect()]
    assert at == pytest.approx([0, 0, 0.5 / 3, 2 / 3, 2.5 / 3, 1, 0])


def test_cells_move_back_and_columns_move(spark):
    assert [repair.column_number(x) for x in ("A", "bk", "CK")] == [0, 62, 88]
    with pytest.raises(ValueError):
        repair.column_number("A1")
    rows = spark.createDataFrame([("f", 0, "a,'b,c',,d,'x',e"), ("f", 1, "a"), ("f", 2, "a,b,c,d,e"), ("f", 3, ""), ("f", 4, "a,'b,c")], "path string, n int, value string")
    got = {r.n: (r.value, r.fate) for r in repair.move_back(rows, 2, 4).collect()}
    assert got[0] == ("a,'b,c','x',d,,e", "moved")
    assert [got[i][1] for i in (1, 2, 3, 4)] == ["too_short", "both_filled", "blank", "odd_quotes"]
    rows = spark.createDataFrame([("f", 0, ""), ("f", 1, "'a','m','b','c'"), ("f", 2, "1,2,3,4,"), ("f", 3, "1,2"), ("g", 0, "'b','m'"), ("h", 0, "x,y")], "path string, n int, value string")
    got = {(r.path, r.n): r.value for r in repair.move_column(rows, "m", "b").collect()}
    assert got["f", 1] == "'a','b','m','c'" and got["f", 2] == "1,3,2,4," and got["f", 3] == "1,2" and got["f", 0] == ""
    assert got["g", 0] == "'b','m'" and got["h", 0] == "x,y"


def test_processing_corrects_and_detects(spark):
    rows = []
    for k in range(3):
        for i in range(120):
            y = i * 3.0 if k % 2 == 0 else 357.0 - i * 3.0
            rows.append((len(rows), float(len(rows)), k * 40.0, y, 0, 50000.0 + len(rows) / 100 + i % 3 / 10 + (500.0 if i == 60 else 0.0)))
    p = spark.createDataFrame(rows, "point_id long, t double, x double, y double, source_file_index int, mag_raw double")
    base = spark.createDataFrame([(float(t), 40000.0 + t / 100) for t in range(0, 400, 10)], "t double, mag double")
    got = process(p, base, Settings(most_gap_s=2.0))
    table = got.toPandas()
    assert table[table.line_id >= 0].line_id.nunique() == 3 and table[table.line_id >= 0].tmi.std() < 1  # drift and spikes are gone
    assert set(table[table.line_id < 0].reason) <= {"takeoff_ramp", "landing_ramp", "turn_buffer", "off_azimuth_turn", "takeoff_landing_or_low_speed", "short_line"}
    plain = process(p, None, Settings(despike=False, diurnal=False)).toPandas()
    assert (plain.sort_values("point_id").mag_filtered.to_numpy() == [r[5] for r in rows]).all()
    tables = report(got, base)
    assert tables["survey"].first().n_lines == 3 and tables["cover"].first().coverage_pct == 100
    for bad in ({"tolerance_deg": 0.5}, {"despike_k": 0.0}, {"least_speed": -1.0}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_margins_and_rings(spark):
    g = spark.createDataFrame([(r, c, c * 10.0, r * 10.0, None if (r, c) == (4, 4) else 1.0) for r in range(9) for c in range(9)], "row int, col int, easting double, northing double, value double")
    marked = {(r.row, r.col): r.in_margin for r in spatial.edge_margin(g, 10.0, 10.0).collect()}
    assert all(marked[r, c] == (min(r, c, 8 - r, 8 - c) == 0 or abs(r - 4) + abs(c - 4) == 1) for r, c in marked)
    wide = spatial.mask_margin(spatial.edge_margin(g, 10.0, 60.0))
    assert wide.filter("value is not null").count() == 80  # a margin over everything masks nothing
    assert spatial.keep_inside(g, []) is g


def test_days_and_minutes_of_stations(spark):
    s = spark.createDataFrame([(86400.0 * 10 + 60 * m, float(m)) for m in range(1000)], "t double, mag double")
    days = spark.createDataFrame([(9,), (10,), (20,)], "day long")
    got = timejoin.with_neighbour_days(s, days).groupBy("day", "substitute").count().collect()
    assert {(r.day, r.substitute, r["count"]) for r in got} == {(9, True, 1000), (10, False, 1000)}
    o = spark.createDataFrame([("a", 60.0 * m, float(m)) for m in (0, 1, 4, 20)], "iaga_code string, t double, mag double")
    assert [(r.minute, r.mag) for r in timejoin.bridged_minutes(o).orderBy("minute").collect()] == [(0, 0.0), (1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0), (20, 20.0)]


def test_ramps_of_a_file_without_lines_stay(spark):
    df = spark.createDataFrame([(0, 0.0, -1, "short_line", 0), (1, 0.0, -1, None, 1), (2, 1.0, 0, None, 1), (3, 2.0, -1, "turn_buffer", 1)], "point_id long, t double, line_id int, reason string, source_file_index int")
    assert [r.reason for r in lines.tag_ramps(df).orderBy("point_id").collect()] == ["short_line", "takeoff_ramp", None, "landing_ramp"]


def test_base_processing_can_leave_out_steps(spark):
    rows = [(0, i, 100.0 + i * i % 7 / 10 + (300.0 if i == 50 else 0.0)) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, i int, v double")
    whole = series.process_base(df, "v", ["k"], ["i"], 11, 5, trim=False, spikes=False).count()
    clean = series.process_base(df, "v", ["k"], ["i"], 11, 5, trim=False)
    assert whole == clean.count() == 100 and clean.agg(F.max("v")).first()[0] < 101


def test_inversion_chooses_its_damping_and_finds_the_block(spark):
    import numpy as np
    import pandas as pd

    from fluxlode.operators import inversion

    columns = spark.createDataFrame([(r, c, c * 20.0, r * 20.0, 0.0) for r in range(9) for c in range(9)], "row int, col int, x double, y double, ground double")
    mesh = inversion.build_mesh(columns, 20.0, 100.0, 4)
    obs = pd.DataFrame([(x * 20.0, y * 20.0, 30.0) for x in range(9) for y in range(9)], columns=["x", "y", "z"])
    kernel = inversion.sensitivity(mesh, obs, 20.0, 55.0, -8.0, 50000.0).persist()
    block = kernel.filter("layer = 1 and row between 3 and 5 and col between 3 and 5").toPandas()
    data = 0.05 * np.stack(block["g"].to_numpy()).sum(0)
    strength, scan = inversion.choose_strength(kernel, data, 2.0)
    assert scan["reached"] and all(a <= b + 1e-9 for a, b in zip(scan["rms"], scan["rms"][1:]))
    assert strength < 1e3 and not inversion.choose_strength(kernel, data, 1e-9)[1]["reached"]
    points = spark.createDataFrame([(float(a), float(b), float(v)) for a, b, v in zip(obs.x, obs.y, data)], "x double, y double, value double")
    model, report = inversion.run_inversion(points, "value", 20.0, 30.0, 100.0, 4, 55.0, -8.0, 50000.0, target_rms=2.0, spacing=10.0)
    top = model.toPandas().nlargest(9, "chi")
    assert report["observations"] == 81 and abs(top.x.mean() - 80) < 25 and abs(top.y.mean() - 80) < 25
    assert len(report["advice"]) == 1
    kernel.unpersist()
