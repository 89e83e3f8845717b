"""Queries over lines, space, grids and models, with their equals in DuckDB's SQL."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from ..operators import gridding, interpretation, inversion, leveling, series, spatial, stats
from ..operators import transforms as tf
from .fourier import transform_sql
from .points import DESPIKE, PMOD, W, query
from .tables import ctes, q6, r6, view

PROFILES = """, p AS (SELECT line_id, CAST(floor((x * cos(radians(90)) + y * sin(radians(90))) / 25) AS BIGINT) AS bin, median(mag_raw) AS value, avg(-x * sin(radians(90)) + y * cos(radians(90))) AS across FROM survey GROUP BY 1, 2)"""
DELTAS = """, o AS (SELECT line_id, row_number() OVER (ORDER BY avg(across), line_id) - 1 AS k, lead(line_id) OVER (ORDER BY avg(across), line_id) AS next_id, count(*) AS n FROM p GROUP BY line_id),
g AS (SELECT o.k, median(a.value - b.value) AS d, count(*) AS common FROM o JOIN p a ON a.line_id = o.line_id JOIN p b ON b.line_id = o.next_id AND a.bin = b.bin GROUP BY o.k),
dl AS (SELECT CAST(o.k AS INT) AS k, o.line_id, o.next_id, CASE WHEN common >= 8 AND common >= 0.25 * least(o.n, m.n) THEN d END AS delta FROM o JOIN o m ON m.line_id = o.next_id LEFT JOIN g ON g.k = o.k),
lv AS (SELECT k, line_id, -coalesce(sum(coalesce(delta, 0)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS level FROM (SELECT k, line_id, delta FROM dl UNION ALL SELECT max(k) + 1, max_by(next_id, k), 0 FROM dl))"""


def _evened(spark, d):
    """Even lines run with y, odd ones against it; here all run over the same stretch."""
    return view(spark, d, "survey").withColumn("y", F.abs("y"))


EVEN = ctes("survey").replace("s * -5.0::DOUBLE", "s * 5.0::DOUBLE")


def _profiles(spark, d):
    return leveling.line_profiles(_evened(spark, d), "mag_raw", 90.0, 25.0)


@query("g_line_profiles", EVEN + PROFILES + f" SELECT line_id, bin, {q6('value')} AS value, {q6('across')} AS across FROM p")
def profiles(spark, d):
    return _profiles(spark, d).select("line_id", "bin", r6("value").alias("value"), r6("across").alias("across"))


@query("g_adjacent_deltas", EVEN + PROFILES + DELTAS + f" SELECT k, line_id, next_id, {q6('delta')} AS delta FROM dl")
def deltas(spark, d):
    return leveling.adjacent_deltas(_profiles(spark, d)).select(F.col("k").cast("int").alias("k"), "line_id", "next_id", r6("delta").alias("delta"))


@query("g_chain_levels", EVEN + PROFILES + DELTAS + f" SELECT k, line_id, {q6('level')} AS level FROM lv")
def levels(spark, d):
    return leveling.chain_levels(leveling.adjacent_deltas(_profiles(spark, d))).select(F.col("k").cast("int").alias("k"), "line_id", r6("level").alias("level"))


@query("g_striping", EVEN + PROFILES + DELTAS + f""", s AS (SELECT avg(abs(d2)) AS stripe_nt FROM (SELECT level - 2 * lag(level) OVER (ORDER BY k) + lag(level, 2) OVER (ORDER BY k) AS d2 FROM lv)),
r AS (SELECT quantile_cont(mag_raw, 0.95) - quantile_cont(mag_raw, 0.05) AS range_nt FROM survey) SELECT {q6("stripe_nt")} AS stripe_nt, {q6("range_nt")} AS range_nt, {q6("stripe_nt / range_nt")} AS ratio FROM s, r""")  # fmt: skip
def striping(spark, d):
    lv = leveling.chain_levels(leveling.adjacent_deltas(_profiles(spark, d)))
    return leveling.striping(lv, view(spark, d, "survey"), "mag_raw").select(*[r6(c).alias(c) for c in ("stripe_nt", "range_nt", "ratio")])


def _trend(window: int = 9, rounds: int = 3) -> str:
    """A weighted quadratic through the neighbours' levels at each line, by normal equations and Cramer's rule, its weights renewed."""
    h, out = window // 2, ""
    out += f", w0 AS MATERIALIZED (SELECT a.k AS i, b.k - a.k AS o, b.level AS v, 1.0::DOUBLE AS w, TRUE AS open, 0.0::DOUBLE AS fit FROM lv a JOIN lv b ON abs(b.k - a.k) <= {h})"
    for r in range(rounds):
        det = "(s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2))"
        out += f""", n{r} AS (SELECT i, sum(w) AS s0, sum(w * o) AS s1, sum(w * o * o) AS s2, sum(w * o * o * o) AS s3, sum(w * o * o * o * o) AS s4, sum(w * v) AS y0, sum(w * v * o) AS y1, sum(w * v * o * o) AS y2 FROM w{r} GROUP BY i),
c{r} AS (SELECT i, (y0 * (s2 * s4 - s3 * s3) - s1 * (y1 * s4 - s3 * y2) + s2 * (y1 * s3 - s2 * y2)) / {det} AS a, (s0 * (y1 * s4 - s3 * y2) - y0 * (s1 * s4 - s2 * s3) + s2 * (s1 * y2 - y1 * s2)) / {det} AS b,
  (s0 * (s2 * y2 - y1 * s3) - s1 * (s1 * y2 - y1 * s2) + y0 * (s1 * s3 - s2 * s2)) / {det} AS c FROM n{r}),
r{r} AS (SELECT w.i, o, v, open, CASE WHEN open THEN a ELSE w.fit END AS fit, v - a - b * o - c * o * o AS left_ FROM w{r} w JOIN c{r} USING (i)),
d{r} AS (SELECT i, median(left_) AS m FROM r{r} GROUP BY i), q{r} AS (SELECT r.i, 1.4826 * median(abs(left_ - m)) AS scale FROM r{r} r JOIN d{r} USING (i) GROUP BY r.i),
w{r + 1} AS MATERIALIZED (SELECT r.i, o, v, CASE WHEN scale > 0 THEN 1 / (1 + pow(left_ / (2 * scale), 2)) ELSE 1 END AS w, open AND scale > 0 AS open, fit FROM r{r} r JOIN q{r} USING (i))"""
    return out + f", f AS (SELECT i, any_value(fit) AS fit FROM w{rounds} GROUP BY i), j AS (SELECT line_id, level - fit AS j FROM lv JOIN f ON f.i = lv.k)"


@query("g_statistical_leveling", EVEN + PROFILES + DELTAS.replace("lv AS (", "lv AS MATERIALIZED (") + _trend() + f" SELECT line_id, {q6('j - (SELECT avg(j) FROM j)')} AS shift FROM j")
def statistical(spark, d):
    return leveling.statistical_shifts(_evened(spark, d), "mag_raw", 90.0, 50.0).select("line_id", r6("shift").alias("shift"))


COV = lambda a, b: f"(sum({a} * {b}) - sum({a}) * sum({b}) / count(*))"
PLANE = ", ".join(f"{COV(a, b)} AS {a}{b}" for a, b in ("uu", "uw", "uh", "ww", "wh", "hh", "uv", "wv", "hv", "vv"))
DET3 = lambda m: f"({m[0]} * ({m[4]} * {m[8]} - {m[5]} * {m[7]}) - {m[1]} * ({m[3]} * {m[8]} - {m[5]} * {m[6]}) + {m[2]} * ({m[3]} * {m[7]} - {m[4]} * {m[6]}))"
GRAM = ["uu", "uw", "uh", "uw", "ww", "wh", "uh", "wh", "hh"]
PART = lambda i: DET3([("uv", "wv", "hv")[k // 3] if k % 3 == i else g for k, g in enumerate(GRAM)])


@query("g_heading_offset", EVEN + f""", o AS (SELECT i, j FROM (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j)),
p AS (SELECT floor(x / 50) + i AS gx, floor(y / 50) + j AS gy, line_id, x - (floor(x / 50) + i + 0.5) * 50 AS u, y - (floor(y / 50) + j + 0.5) * 50 AS w, CASE WHEN line_id % 2 = 0 THEN -0.5 ELSE 0.5 END::DOUBLE AS h, mag_raw - 50000 AS v FROM survey, o),
g AS (SELECT gx, gy, count(*) AS n, {PLANE} FROM p WHERE sqrt(u * u + w * w) <= 100 GROUP BY gx, gy HAVING count(DISTINCT line_id) >= 3 AND count(*) FILTER (h < 0) >= 12 AND count(*) FILTER (h > 0) >= 12),
k AS (SELECT *, {DET3(GRAM)} AS det FROM g), b AS (SELECT n, vv, uv, wv, hv, {PART(0)} / det AS bu, {PART(1)} / det AS bw, {PART(2)} / det AS bh FROM k WHERE det > 1e-6 * uu * ww * hh),
f AS (SELECT bh, sqrt(greatest(vv - bu * uv - bw * wv - bh * hv, 0) / n) AS r FROM b), c AS (SELECT * FROM f WHERE r <= (SELECT quantile_cont(r, 0.4) FROM f)), m AS (SELECT median(bh) AS m FROM c)
SELECT {q6("any_value(m)")} AS "offset", {q6("1.4826 * median(abs(bh - m))")} AS spread, count(*) AS n FROM c, m""")  # fmt: skip
def heading(spark, d):
    s = view(spark, d, "survey").withColumn("y", F.abs("y")).withColumn("group", F.when(F.col("line_id") % 2 == 0, "A").otherwise("B"))
    return leveling.local_plane_offset(s.withColumn("mag_raw", F.col("mag_raw") - 50000), "mag_raw", 50.0).select(r6("offset").alias("offset"), r6("spread").alias("spread"), "n")


@query("g_file_offsets", ctes("track") + f""", d AS (SELECT mag_raw - lag(mag_raw) OVER (PARTITION BY source_file_index ORDER BY t, point_id) AS d FROM track), m AS (SELECT median(d) AS m FROM d),
s AS (SELECT 1.4826 * median(abs(d - m)) AS s FROM d, m), a AS (SELECT median(mag_raw) AS a FROM track), f AS (SELECT source_file_index, count(*) AS n, median(mag_raw) AS md FROM track GROUP BY 1)
SELECT source_file_index, n, {q6("md")} AS median, {q6("md - a")} AS "offset", abs(md - a) > greatest(3 * s, 1.0) AS is_off FROM f, s, a""")  # fmt: skip
def offsets(spark, d):
    return leveling.file_offsets(view(spark, d, "track"), "mag_raw").select("source_file_index", "n", r6("median").alias("median"), r6("offset").alias("offset"), "is_off")


TIED = EVEN.replace("FROM events)", "FROM events)") + """, w AS (SELECT point_id, t, x, y, s, mag_raw, CASE WHEN s % 10 = 3 AND line_id % 5 = 0 THEN line_id ELSE -1 END AS tie, CASE WHEN s % 10 = 3 AND line_id % 5 = 0 THEN -1 ELSE line_id END AS line FROM survey),
v AS (SELECT *, avg(mag_raw) OVER (PARTITION BY line, tie ORDER BY t, point_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM w),
xp AS (SELECT l.line AS line_id, q.tie AS tie_id, l.s, l.v - q.v AS delta, sqrt(pow(l.x - q.x, 2) + pow(l.y - q.y, 2)) AS d, l.point_id AS a, q.point_id AS b FROM v l JOIN v q ON l.line >= 0 AND q.tie >= 0 AND abs(l.x - q.x) <= 60 AND abs(l.y - q.y) <= 60),
xc AS MATERIALIZED (SELECT line_id, tie_id, s, delta, d AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY line_id, tie_id ORDER BY d, a, b) AS k FROM xp WHERE d <= 60) WHERE k = 1)"""


def _crossed(spark, d):
    tie = (F.col("s") % 10 == 3) & (F.col("line_id") % 5 == 0)
    s = view(spark, d, "survey").withColumn("y", F.abs("y")).withColumn("tie_line_id", F.when(tie, F.col("line_id")).otherwise(-1)).withColumn("line_id", F.when(tie, -1).otherwise(F.col("line_id")))
    return leveling.crossings(s, "mag_raw", 60.0)


@query("g_crossings", TIED + f" SELECT line_id, tie_id, s, {q6('delta')} AS delta, {q6('distance_m')} AS distance_m FROM xc")
def crossing(spark, d):
    return _crossed(spark, d).select("line_id", "tie_id", "s", r6("delta").alias("delta"), r6("distance_m").alias("distance_m"))


def _settled(rounds: int = 20, tol: float = 0.01) -> str:
    """Medians in turn for lines and ties, as CTEs of one round after another; a round that follows a small change keeps what was."""
    out = ", l0 AS (SELECT DISTINCT line_id, 0.0::DOUBLE AS v FROM xc), t0 AS (SELECT DISTINCT tie_id, 0.0::DOUBLE AS v FROM xc), o0 AS (SELECT FALSE AS done)"
    for i in range(rounds):
        out += f""", a{i} AS MATERIALIZED (SELECT line_id, median(delta + t.v) AS v FROM xc JOIN t{i} t USING (tie_id) GROUP BY 1), b{i} AS MATERIALIZED (SELECT tie_id, median(a.v - delta) AS v FROM xc JOIN a{i} a USING (line_id) GROUP BY 1),
m{i} AS MATERIALIZED (SELECT avg(v) AS m FROM a{i}), l{i + 1} AS MATERIALIZED (SELECT line_id, CASE WHEN done THEN l.v ELSE a.v - m END AS v FROM a{i} a JOIN l{i} l USING (line_id), m{i}, o{i}),
t{i + 1} AS MATERIALIZED (SELECT tie_id, CASE WHEN done THEN t.v ELSE b.v - m END AS v FROM b{i} b JOIN t{i} t USING (tie_id), m{i}, o{i}),
o{i + 1} AS MATERIALIZED (SELECT done OR greatest((SELECT max(abs(x.v - y.v)) FROM l{i + 1} x JOIN l{i} y USING (line_id)), (SELECT max(abs(x.v - y.v)) FROM t{i + 1} x JOIN t{i} y USING (tie_id))) < {tol} AS done FROM o{i})"""
    return out


@query("g_crossover_shifts", TIED + _settled() + f" SELECT line_id, {q6('v')} AS shift FROM l20")
def crossover(spark, d):
    return leveling.crossover_shifts(_crossed(spark, d))[0].select("line_id", r6("shift").alias("shift"))


@query("g_crossover_lines", TIED + f""", g AS (SELECT line_id, count(*) AS n, regr_slope(delta, s) AS b, regr_intercept(delta, s) AS a, median(delta) AS m FROM xc GROUP BY 1)
SELECT line_id, {q6("CASE WHEN n >= 3 AND b IS NOT NULL AND NOT isnan(b) THEN a ELSE m END")} AS shift, {q6("CASE WHEN n >= 3 AND b IS NOT NULL AND NOT isnan(b) THEN b ELSE 0 END")} AS slope FROM g""")  # fmt: skip
def crossover_lines(spark, d):
    ties = spark.createDataFrame([], "tie_id int, shift double")
    return leveling.crossover_lines(_crossed(spark, d), ties).select("line_id", r6("shift").alias("shift"), r6("slope").alias("slope"))


@query("g_turn_calibration", ctes("track") + f""", c AS (SELECT *, avg(value) OVER w AS m, count(*) OVER w AS n FROM (SELECT source_file_index, CAST(floor(t / 60) AS BIGINT) AS turn_group, x AS theta, y AS phi, mag_raw AS value FROM track) WINDOW w AS (PARTITION BY source_file_index, turn_group))
SELECT theta, phi, {q6("value - m")} AS deviation FROM c WHERE n >= 15""")  # fmt: skip
def calibration(spark, d):
    t = view(spark, d, "track").select("source_file_index", F.floor(F.col("t") / 60).alias("turn_group"), F.col("x").alias("theta"), F.col("y").alias("phi"), F.col("mag_raw").alias("value"))
    return leveling.turn_calibration(t).select("theta", "phi", r6("deviation").alias("deviation"))


@query("g_line_passes", ctes("survey") + f"""SELECT line_id, {q6(PMOD.format(x="degrees(0.5 * atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)))", m=180))} AS axis_deg, {q6("avg(x)")} AS cx, {q6("avg(y)")} AS cy, count(*) AS n,
  CAST(sign(arg_max(y, (t, point_id)) - arg_min(y, (t, point_id))) AS INT) AS direction FROM survey GROUP BY line_id""")  # fmt: skip
def passes(spark, d):
    return leveling.line_passes(view(spark, d, "survey"), "mag_raw").select("line_id", r6("axis_deg").alias("axis_deg"), r6("cx").alias("cx"), r6("cy").alias("cy"), "n", "direction")


POINTS = ctes("survey") + ", a AS (SELECT point_id, x + mag_raw % 10 AS x, y + mag_raw % 7 AS y FROM survey), b AS (SELECT point_id AS other, x AS x2, y AS y2 FROM a)"


def _shaken(spark, d):
    a = view(spark, d, "survey").select("point_id", "mag_raw", (F.col("x") + F.col("mag_raw") % 10).alias("x"), (F.col("y") + F.col("mag_raw") % 7).alias("y"))
    return a, a.select(F.col("point_id").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"))


@query("h_radius_join", POINTS + f" SELECT point_id, other, {q6('sqrt(pow(x - x2, 2) + pow(y - y2, 2))')} AS d FROM a JOIN b ON abs(x - x2) <= 30 AND abs(y - y2) <= 30 WHERE sqrt(pow(x - x2, 2) + pow(y - y2, 2)) <= 30 AND point_id <> other")
def radius(spark, d):
    a, b = _shaken(spark, d)
    return spatial.within(a, b, 30.0).filter("point_id <> other").select("point_id", "other", r6("d").alias("d"))


@query("h_nearest", POINTS + f""", r AS (SELECT point_id, other, sqrt(pow(x - x2, 2) + pow(y - y2, 2)) AS d FROM a JOIN b ON point_id <> other AND abs(x - x2) <= 60 AND abs(y - y2) <= 60), n AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, other) AS k FROM r WHERE d <= 60)
SELECT a.point_id, other, {q6("d")} AS distance_m FROM a LEFT JOIN (SELECT * FROM n WHERE k = 1) n USING (point_id)""")  # fmt: skip
def nearest(spark, d):
    a, b = _shaken(spark, d)
    return spatial.nearest(a, "point_id", b, "other", 12.0, apart=True).select("point_id", "other", r6("distance_m").alias("distance_m"))


RING = [(100.0, -300.0), (900.0, -200.0), (700.0, 100.0), (1200.0, 500.0), (300.0, 700.0)]
EDGES = " + ".join(f"CASE WHEN ({ay} > y) <> ({by} > y) AND x < ({bx - ax}) * (y - ({ay})) / ({by - ay}) + {ax} THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in zip(RING, [*RING[1:], RING[0]]))


@query("h_inside_polygon", ctes("survey") + f"SELECT point_id FROM survey WHERE ({EDGES}) % 2 = 1")
def inside(spark, d):
    return view(spark, d, "survey").filter(spatial.inside_polygon(F.col("x"), F.col("y"), RING)).select("point_id")


@query("h_polygon_join", ctes("survey") + f"SELECT point_id, 7 AS polygon_id FROM survey WHERE ({EDGES}) % 2 = 1")
def polygon(spark, d):
    ring = spark.createDataFrame([(7, [{"x": x, "y": y} for x, y in RING])], "polygon_id int, path array<struct<x:double,y:double>>")
    return spatial.in_polygons(view(spark, d, "survey").select("point_id", "x", "y"), ring, 200.0).select("point_id", "polygon_id")


@query("h_components", ctes("survey") + """, n AS (SELECT point_id AS id, x, y * 2 + mag_raw % 23 AS y FROM survey),
s AS (SELECT id, x, y, CASE WHEN y - lag(y) OVER (PARTITION BY x ORDER BY y, id) <= 20 THEN 0 ELSE 1 END AS cut FROM n), g AS (SELECT id, x, sum(cut) OVER (PARTITION BY x ORDER BY y, id) AS g FROM s)
SELECT id, min(id) OVER (PARTITION BY x, g) AS component FROM g""")  # fmt: skip
def components(spark, d):
    n = view(spark, d, "survey").select(F.col("point_id").alias("id"), "x", (F.col("y") * 2 + F.col("mag_raw") % 23).alias("y"))
    return spatial.clusters(n, 20.0).select("id", "component")


@query("h_local_maxima", ctes("grid") + """SELECT row, col, round(value, 6) + 0.0::DOUBLE AS value FROM grid g WHERE NOT EXISTS (SELECT 1 FROM grid h WHERE h.row BETWEEN g.row - 1 AND g.row + 1 AND h.col BETWEEN g.col - 1 AND g.col + 1 AND h.value > g.value)""")
def maxima(spark, d):
    return spatial.local_maxima(view(spark, d, "grid")).select("row", "col", r6("value").alias("value"))


LATTICE = ", b0 AS (SELECT min(x) AS x0, min(y) AS y0, CAST(round((max(x) - min(x)) / {s}) AS INT) + 1 AS nx, CAST(round((max(y) - min(y)) / {s}) AS INT) + 1 AS ny FROM survey), c AS (SELECT CAST(r AS INT) AS row, CAST(k AS INT) AS col, x0 + k * {s}::DOUBLE AS x, y0 + r * {s}::DOUBLE AS y FROM b0, unnest(range(ny)) t(r), unnest(range(nx)) u(k))"


@query("h_line_gap", ctes("survey") + LATTICE.format(s=25) + f""", m AS (SELECT row, col, line_id, min(sqrt(pow(c.x - s.x, 2) + pow(c.y - s.y, 2))) AS d FROM c, survey s GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY d, line_id) AS n FROM m) SELECT row, col, {q6("sum(d)")} AS gap_m FROM k WHERE n <= 2 GROUP BY row, col""")  # fmt: skip
def gap(spark, d):
    points = view(spark, d, "survey")
    x0, y0, nx, ny = gridding.lattice(points, 25.0, math.inf)
    cells = gridding.nodes(spark, x0, y0, nx, ny, 25.0).withColumn("x", F.col("easting")).withColumn("y", F.col("northing"))
    return spatial.line_gap(cells, points.select("line_id", F.col("x").alias("x2"), F.col("y").alias("y2")), 50.0).select("row", "col", r6("gap_m").alias("gap_m"))


@query("i_boxing", ctes("survey") + f"SELECT CAST(floor((y + 500) / 20 + 0.5) AS INT) AS row, CAST(floor(x / 20 + 0.5) AS INT) AS col, {q6('avg(mag_raw)')} AS value, count(*) AS n FROM survey GROUP BY 1, 2")
def boxing(spark, d):
    return gridding.boxing(view(spark, d, "survey"), "mag_raw", 0.0, -500.0, 20.0).select("row", "col", r6("value").alias("value"), "n")


@query("i_nearest_grid", ctes("survey") + LATTICE.format(s=30) + f""", m AS (SELECT row, col, point_id, mag_raw, sqrt(pow(c.x - s.x, 2) + pow(c.y - s.y, 2)) AS d FROM c JOIN survey s ON abs(c.x - s.x) <= 40 AND abs(c.y - s.y) <= 40), n AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY d, point_id) AS k FROM m WHERE d <= 40)
SELECT row, col, {q6("mag_raw")} AS value, {q6("CASE WHEN d IS NULL THEN 0 ELSE greatest(0, least(1, 1 - d / 40)) END")} AS confidence FROM c LEFT JOIN (SELECT * FROM n WHERE k = 1) n USING (row, col)""")  # fmt: skip
def nearest_grid(spark, d):
    points = view(spark, d, "survey")
    return gridding.nearest_grid(points, "mag_raw", *gridding.lattice(points, 30.0, math.inf), 30.0, 40.0).select("row", "col", r6("value").alias("value"), r6("confidence").alias("confidence"))


@query("i_plane_residual", ctes("grid") + f""", s AS (SELECT avg(value) AS v, avg(easting) AS e, avg(northing) AS n, (covar_pop(easting, value) * var_pop(northing) - covar_pop(northing, value) * covar_pop(easting, northing)) / (var_pop(easting) * var_pop(northing) - pow(covar_pop(easting, northing), 2)) AS a,
  (covar_pop(northing, value) * var_pop(easting) - covar_pop(easting, value) * covar_pop(easting, northing)) / (var_pop(easting) * var_pop(northing) - pow(covar_pop(easting, northing), 2)) AS b FROM grid)
SELECT row, col, {q6("value - v - a * (easting - e) - b * (northing - n)", 4)} AS residual FROM grid, s""")  # fmt: skip
def plane(spark, d):
    return gridding.polynomial_residual(view(spark, d, "grid"), 1).select("row", "col", r6("residual", 4).alias("residual"))


@query("i_quantile_stops", ctes("grid") + f"SELECT i, {q6('q')} AS stop FROM (SELECT unnest(range(5)) AS i, unnest(quantile_cont(value, [0.02, 0.25, 0.5, 0.75, 0.98])) AS q FROM grid)")
def stops(spark, d):
    got = gridding.stretch_stops(view(spark, d, "grid"), [0.02, 0.25, 0.5, 0.75, 0.98], "quantile")
    return got.select(F.posexplode("stops").alias("i", "s")).select(F.col("i").cast("long").alias("i"), r6("s").alias("stop"))


@query("i_equalized", ctes("grid") + f"SELECT row, col, {q6('(rank() OVER (ORDER BY value) - 1) / (count(*) OVER () - 1)::DOUBLE')} AS rank FROM grid")
def equalized(spark, d):
    return gridding.equalized(view(spark, d, "grid")).select("row", "col", r6("rank").alias("rank"))


def _cut(a: str, b: str) -> str:
    share = f"(level - {a}.v) / ({b}.v - {a}.v)"
    return f"CASE WHEN ({a}.v < level) <> ({b}.v < level) THEN {{'x': {a}.e + {share} * ({b}.e - {a}.e), 'y': {a}.n + {share} * ({b}.n - {a}.n)}} END"


@query("i_contours", ctes("grid") + f""", c AS (SELECT row, col, {{'v': value, 'e': easting, 'n': northing}} AS p FROM grid),
q AS (SELECT a.p AS p0, b.p AS p1, c.p AS p2, d.p AS p3 FROM c a JOIN c b ON b.row = a.row AND b.col = a.col + 1 JOIN c ON c.row = a.row + 1 AND c.col = a.col JOIN c d ON d.row = a.row + 1 AND d.col = a.col + 1),
t AS (SELECT p0 AS a, p1 AS b, p2 AS c FROM q UNION ALL SELECT p3, p1, p2 FROM q), l AS (SELECT *, unnest([50.0, 55.0, 60.0])::DOUBLE AS level FROM t),
e AS (SELECT level, list_filter([{_cut("a", "b")}, {_cut("b", "c")}, {_cut("a", "c")}], lambda z: z IS NOT NULL) AS e FROM l)
SELECT level, {q6("e[1].x")} AS ax, {q6("e[1].y")} AS ay, {q6("e[2].x")} AS bx, {q6("e[2].y")} AS by FROM e WHERE len(e) = 2""")  # fmt: skip
def contours(spark, d):
    found = gridding.contour_segments(view(spark, d, "grid"), [50.0, 55.0, 60.0])
    return found.select("level", *[r6(c).alias(c) for c in ("ax", "ay", "bx", "by")])


@query("i_minimum_curvature")
def curvature(spark, d):
    g = view(spark, d, "grid").withColumn("value", F.when((F.col("row") + F.col("col")) % 3 > 0, F.col("value"))).withColumn("grid_id", F.lit(0))
    return gridding.by_kernel(g, lambda a, c: gridding.minimum_curvature(a))


def _transform(name: str, **p):
    def run(spark, d):
        g = view(spark, d, "grid").withColumn("grid_id", F.explode(F.array(F.lit(0), F.lit(1))))
        return gridding.by_kernel(g, lambda a, c: tf.transform(a, c, name, **p)).withColumn("value", r6("value"))

    return run


for _name, _p in {
    "rtp": {"inclination": 55.0, "declination": -8.0}, "rte": {"inclination": 55.0, "declination": -8.0}, "upward": {"height": 20.0}, "microlevel": {"azimuth": 0.0, "spacing": 20.0},
    **{n: {} for n in ("1vd", "2vd", "dx", "dy", "dxx", "dyy", "dxy", "dxz", "dyz", "as", "thdr", "tilt", "theta")},
}.items():
    query(f"j_{_name}", transform_sql(_name))(_transform(_name, **_p))


@query("k_prospectivity", ctes("grid") + f""", l AS (SELECT row, col, value AS a, CASE WHEN (row + col) % 4 > 0 THEN row * 1.0 END AS b FROM grid), q AS (SELECT quantile_cont(a, [0.02, 0.98]) AS qa, quantile_cont(b, [0.02, 0.98]) AS qb FROM l),
s AS (SELECT row, col, greatest(0, least(1, (a - qa[1]) / (qa[2] - qa[1]))) AS sa, CASE WHEN b IS NOT NULL THEN greatest(0, least(1, (b - qb[1]) / (qb[2] - qb[1]))) END AS sb FROM l, q)
SELECT row, col, {q6("(0.7 * sa + coalesce(0.3 * sb, 0)) / (0.7 + CASE WHEN sb IS NULL THEN 0 ELSE 0.3 END)")} AS score FROM s""")  # fmt: skip
def prospect(spark, d):
    g = view(spark, d, "grid").select("row", "col", F.col("value").alias("a"), F.when((F.col("row") + F.col("col")) % 4 > 0, F.col("row") * 1.0).alias("b"))
    return interpretation.prospectivity(g, {"a": 0.7, "b": 0.3}).select("row", "col", r6("score").alias("score"))


@query("k_lineaments", ctes("grid").replace("WITH ", "WITH RECURSIVE ", 1) + f""", p AS (SELECT CAST(row * 1000 + col AS BIGINT) AS id, easting AS x, northing AS y FROM grid g WHERE value >= (SELECT quantile_cont(value, 0.7) FROM grid)
  AND NOT EXISTS (SELECT 1 FROM grid h WHERE h.row BETWEEN g.row - 1 AND g.row + 1 AND h.col BETWEEN g.col - 1 AND g.col + 1 AND h.value > g.value)),
c AS (SELECT id, id AS t FROM p UNION SELECT c.id, b.id FROM c JOIN p a ON a.id = c.t JOIN p b ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 30), k AS (SELECT id, min(t) AS component FROM c GROUP BY id),
s AS (SELECT component, count(*) AS n_points, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS a, avg(x) AS mx, avg(y) AS my FROM p JOIN k USING (id) GROUP BY component HAVING count(*) >= 3)
SELECT s.component, n_points, {q6(PMOD.format(x="90 - degrees(a)", m=180))} AS strike_deg, {q6("max(x * cos(a) + y * sin(a)) - min(x * cos(a) + y * sin(a))")} AS length_m, {q6("any_value(mx)")} AS x, {q6("any_value(my)")} AS y
FROM s JOIN k USING (component) JOIN p USING (id) GROUP BY s.component, n_points, a""")  # fmt: skip
def lineaments(spark, d):
    e = interpretation.edge_points(view(spark, d, "grid"), 70.0)
    pts = e.select((F.col("row") * 1000 + F.col("col")).cast("long").alias("id"), F.col("easting").alias("x"), F.col("northing").alias("y"))
    return interpretation.segments(pts, 30.0, 3).select("component", "n_points", *[r6(c).alias(c) for c in ("strike_deg", "length_m", "x", "y")])


@query("k_signal_depths", ctes("grid") + f""", a AS (SELECT row, col, abs(value - 55) AS v FROM grid), p AS (SELECT * FROM a WHERE v >= (SELECT quantile_cont(v, 0.9) FROM a) AND NOT EXISTS (SELECT 1 FROM a h WHERE h.row BETWEEN a.row - 1 AND a.row + 1 AND h.col BETWEEN a.col - 1 AND a.col + 1 AND h.v > a.v))
SELECT p.row, p.col, {q6("p.v")} AS value, {q6("min(sqrt(pow(p.row - o.row, 2) + pow(p.col - o.col, 2))) * 10")} AS depth FROM p JOIN a o ON o.v <= p.v / 2 AND sqrt(pow(p.row - o.row, 2) + pow(p.col - o.col, 2)) <= 15 GROUP BY p.row, p.col, p.v""")  # fmt: skip
def signal(spark, d):
    g = view(spark, d, "grid").withColumn("value", F.abs(F.col("value") - 55))
    return interpretation.signal_depths(g, 10.0).withColumn("value", r6("value")).withColumn("depth", r6("depth"))


NEXT = """, v AS (SELECT g.row, g.col, g.value - 55 AS v, e.value - 55 AS e, w.value - 55 AS w, n.value - 55 AS n, s.value - 55 AS s FROM grid g LEFT JOIN grid e ON e.row = g.row AND e.col = g.col + 1 LEFT JOIN grid w ON w.row = g.row AND w.col = g.col - 1
  LEFT JOIN grid n ON n.row = g.row + 1 AND n.col = g.col LEFT JOIN grid s ON s.row = g.row - 1 AND s.col = g.col)"""


@query("k_tilt_depths", ctes("grid") + NEXT + f""", x AS (SELECT *, coalesce((e - w) / 20, (e - v) / 10, (v - w) / 10) AS de, coalesce((n - s) / 20, (n - v) / 10, (v - s) / 10) AS dn FROM v),
d AS (SELECT row, col, 1 / sqrt(pow(radians(de), 2) + pow(radians(dn), 2)) AS depth FROM x WHERE (v * e < 0 OR v * n < 0 OR v = 0) AND NOT (de = 0 AND dn = 0)) SELECT row, col, {q6("depth")} AS depth FROM d WHERE depth BETWEEN 1 AND 500""")  # fmt: skip
def tilt(spark, d):
    g = view(spark, d, "grid").withColumn("value", F.col("value") - 55)
    return interpretation.tilt_depths(g, 10.0).withColumn("depth", r6("depth"))


@query("l_stats", ctes("survey") + f"SELECT line_id, count(mag_raw) AS n, min(mag_raw) AS min, max(mag_raw) AS max, {q6('avg(mag_raw)')} AS mean, {q6('stddev_samp(mag_raw)')} AS std FROM survey GROUP BY line_id")
def basic(spark, d):
    return stats.basic_stats(view(spark, d, "survey"), "mag_raw", ["line_id"]).select("line_id", "n", "min", "max", r6("mean").alias("mean"), r6("std").alias("std"))


@query("l_robust_scale", ctes("survey") + f", m AS (SELECT median(mag_raw) AS c FROM survey) SELECT {q6('c')} AS center, {q6('1.4826 * (SELECT median(abs(mag_raw - c)) FROM survey, m)')} AS scale FROM m")
def robust(spark, d):
    return stats.robust_scale(view(spark, d, "survey"), "mag_raw").select(r6("center").alias("center"), r6("scale").alias("scale"))


@query("l_extrema", ctes("grid") + """(SELECT 'max' AS kind, row, col, easting, northing, round(value, 6) + 0.0::DOUBLE AS value FROM grid ORDER BY grid.value DESC, row, col LIMIT 1) UNION ALL (SELECT 'min', row, col, easting, northing, round(value, 6) + 0.0::DOUBLE FROM grid ORDER BY grid.value, row, col LIMIT 1)""")
def extremes(spark, d):
    return stats.extrema(view(spark, d, "grid")).withColumn("value", r6("value"))


@query("l_survey_summary", ctes("survey") + f"SELECT count(*) AS n_points, count(DISTINCT source_file_index) AS n_files, count(DISTINCT line_id) AS n_lines, min(t) AS t_start, max(t) AS t_end, {q6('(1 - avg(CASE WHEN line_id >= 0 THEN 1.0 ELSE 0.0 END)) * 100')} AS excluded_pct FROM survey")
def survey_summary(spark, d):
    return stats.survey_summary(view(spark, d, "survey")).withColumn("excluded_pct", r6("excluded_pct"))


@query("l_line_profile", ctes("track") + f", s AS (SELECT point_id, t, mag_raw, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS d FROM track WHERE source_file_index = 2 WINDOW w AS (ORDER BY t, point_id)) SELECT point_id, {q6('sum(d) OVER (ORDER BY t, point_id)', 4)} AS distance_m, mag_raw AS value FROM s")
def profile(spark, d):
    t = view(spark, d, "track").withColumn("line_id", F.col("source_file_index"))
    return stats.line_profile(t, 2, "mag_raw").withColumn("distance_m", r6("distance_m", 4))


@query("m_mesh", ctes("grid") + f""", t AS (SELECT i AS layer, pow(1.15, i) AS w FROM (SELECT unnest(range(6)) AS i)), l AS (SELECT layer, 120 * w / (SELECT sum(w) FROM t) AS th, 120 * (SELECT coalesce(sum(u.w), 0) FROM t u WHERE u.layer < t.layer) / (SELECT sum(w) FROM t) AS top FROM t), g AS (SELECT max(value) AS m FROM grid)
SELECT row, col, CAST(layer AS INT) AS layer, {q6("m - top - th / 2")} AS z, {q6("th")} AS thickness_m, m - top - th / 2 < value AS active FROM grid, l, g""")  # fmt: skip
def mesh(spark, d):
    c = view(spark, d, "grid").select("row", "col", F.col("easting").alias("x"), F.col("northing").alias("y"), F.col("value").alias("ground"))
    return inversion.build_mesh(c, 10.0, 120.0, 6).select("row", "col", "layer", r6("z").alias("z"), r6("thickness_m").alias("thickness_m"), "active")


@query("m_near_surface", ctes("grid") + """, m AS (SELECT row, col, k AS layer, value * (k + 1) AS chi FROM grid, (SELECT unnest(range(4)) AS k) WHERE (row + col + k) % 5 > 0), t AS (SELECT *, min(layer) OVER (PARTITION BY row, col) AS t FROM m)
SELECT row, col, round(avg(chi), 6) + 0.0::DOUBLE AS chi FROM t WHERE layer < t + 2 GROUP BY row, col""")  # fmt: skip
def surface(spark, d):
    m = view(spark, d, "grid").withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(3)))).filter((F.col("row") + F.col("col") + F.col("layer")) % 5 > 0).withColumn("chi", F.col("value") * (F.col("layer") + 1))
    return inversion.near_surface(m).select("row", "col", r6("chi").alias("chi"))


SERIES = re.sub(r"PARTITION BY line_id( ORDER BY s)?", lambda m: "ORDER BY t, point_id" if m[1] else "", DESPIKE)


@query("d_global_despike", SERIES)
def global_despike(spark, d):
    """One series over all lines, in chunks of its order with halos, so no window covers it whole."""
    s = series.with_halo(series.global_index(view(spark, d, "survey"), ["t", "point_id"]), "i", 2000, 16)
    return series.despike(s, "mag_raw", ["chunk"], ["i"]).filter("own").select("point_id", "is_spike", r6("despiked").alias("despiked"))
