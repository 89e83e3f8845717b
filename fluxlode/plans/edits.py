"""Queries over edits, measures, passes, masks and summaries, with their equals in DuckDB's SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geo, measure
from ..operators import editing, gridding, interpretation, inversion, leveling, series, spatial, stats, timejoin
from ..sources import sinks
from .points import LINE, ORDER, OVER, PMOD, W, _diff, query
from .surfaces import EDGES, EVEN, RING, _evened
from .tables import ctes, q6, r6, view

EDITED = ctes("survey") + """, p AS (SELECT *, CASE WHEN s % 11 = 0 THEN -1 ELSE line_id END AS line, CASE WHEN s % 22 = 0 THEN 'takeoff_ramp' WHEN s % 11 = 0 THEN 'turn_buffer' END AS reason, 36.0::DOUBLE + y / 100000 AS lat, 127.0::DOUBLE + x / 100000 AS lon FROM survey)"""


def _edited(spark, d):
    s, off = view(spark, d, "survey"), F.col("s") % 11 == 0
    s = s.withColumn("reason", F.when(F.col("s") % 22 == 0, "takeoff_ramp").when(off, "turn_buffer")).withColumn("line_id", F.when(off, -1).otherwise(F.col("line_id"))).withColumn("tie_line_id", F.lit(-1))
    return s.withColumn("lat", 36.0 + F.col("y") / 100000).withColumn("lon", 127.0 + F.col("x") / 100000)


DRAWN = [(36.0 + y / 100000, 127.0 + x / 100000) for x, y in RING]
INSIDE = " + ".join(f"CASE WHEN ({a[0]!r}::DOUBLE > lat) <> ({b[0]!r}::DOUBLE > lat) AND lon < ({b[1] - a[1]!r}::DOUBLE) * (lat - {a[0]!r}::DOUBLE) / ({b[0] - a[0]!r}::DOUBLE) + {a[1]!r}::DOUBLE THEN 1 ELSE 0 END" for a, b in zip(DRAWN, [*DRAWN[1:], DRAWN[0]]))
STATE = EDITED + f""", o AS (SELECT *, CASE WHEN reason IS NOT DISTINCT FROM 'takeoff_ramp' THEN line >= 0 WHEN line = 5 THEN FALSE WHEN ({INSIDE}) % 2 = 1 THEN TRUE ELSE line >= 0 END AS active FROM p)"""


def _overrides(spark, d):
    p = _edited(spark, d)
    return p, editing.set_exclusion(p, editing.set_exclusion(p, None, "include", polygons=[DRAWN]), "exclude", lines=[5])


@query("h_exclusion_state", STATE + " SELECT point_id, NOT active AS excluded FROM o")
def exclusion(spark, d):
    return editing.exclusion_state(*_overrides(spark, d))


@query("l_point_list", STATE + f" SELECT point_id, {q6('x')} AS x, mag_raw AS value, line AS line_id, NOT active AS excluded, reason IS NOT DISTINCT FROM 'takeoff_ramp' AS is_ramp FROM o")
def point_list(spark, d):
    p, o = _overrides(spark, d)
    return editing.point_list(p, "mag_raw", o).select("point_id", r6("x").alias("x"), "value", "line_id", "excluded", "is_ramp")


@query("n_visible_points", STATE + " SELECT point_id FROM o WHERE NOT (reason IS NOT DISTINCT FROM 'takeoff_ramp' AND NOT active)")
def visible(spark, d):
    p, o = _overrides(spark, d)
    return editing.without_hidden_ramps(editing.point_list(p, "mag_raw", o)).select("point_id")


@query("n_rectangle", STATE + " SELECT point_id FROM o WHERE x BETWEEN 200 AND 900 AND y BETWEEN -300 AND 400 AND active")
def rectangle(spark, d):
    p, o = _overrides(spark, d)
    return editing.in_rectangle(editing.point_list(p, "mag_raw", o), (900.0, -300.0), (200.0, 400.0), "exclude")


@query("n_profile_range", ctes("survey") + ", q AS (SELECT point_id, sum(d) OVER (ORDER BY t, point_id) AS dist FROM (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS d FROM survey WHERE line_id = 7 WINDOW w AS (ORDER BY t, point_id))) SELECT point_id FROM q WHERE dist BETWEEN 102 AND 333")
def profile_range(spark, d):
    return editing.in_range(stats.line_profile(view(spark, d, "survey"), 7, "mag_raw"), 333.0, 102.0)


@query("d_set_smoothing", ctes("survey") + f""", p0 AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY t, point_id) AS i, 36.0::DOUBLE + y / 100000 AS lat, 127.0::DOUBLE + x / 100000 AS lon FROM survey),
f AS (SELECT *, ({INSIDE}) % 2 = 1 OR line_id = 3 AS bad FROM p0), r AS (SELECT *, i - row_number() OVER (PARTITION BY line_id, bad ORDER BY i) AS run FROM f),
p AS (SELECT point_id, line_id, i, bad, mag_raw, row_number() OVER (PARTITION BY line_id, bad, run ORDER BY i) AS pos, count(*) OVER (PARTITION BY line_id, bad, run) AS n FROM r),
c AS (SELECT line_id, i, median(mag_raw) OVER (PARTITION BY line_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS b, median(mag_raw) OVER (PARTITION BY line_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS a FROM p WHERE NOT bad),
x AS (SELECT p.*, l.b, h.a FROM p ASOF LEFT JOIN c l ON p.line_id = l.line_id AND p.i >= l.i ASOF LEFT JOIN (SELECT line_id, i, a FROM c) h ON p.line_id = h.line_id AND p.i <= h.i)
SELECT point_id, {q6("CASE WHEN bad THEN coalesce(b + (a - b) * pos / (n + 1), b, a, mag_raw) ELSE mag_raw END")} AS tmi FROM x""")  # fmt: skip
def set_smoothing(spark, d):
    p = _edited(spark, d).withColumn("line_id", F.col("user_id").cast("int") % 40).withColumn("tmi", F.col("mag_raw"))
    chosen = editing.add_smoothing(p, editing.add_smoothing(p, None, lines=[3]), polygons=[DRAWN])
    return editing.smoothed(p, chosen).select("point_id", r6("tmi").alias("tmi"))


PATHS = ctes("geo") + ", g AS (SELECT point_id // 50 AS g, list({'lat': lat, 'lon': lon} ORDER BY point_id) AS p FROM geo GROUP BY 1)"


def _paths(spark, d):
    p = F.array_sort(F.collect_list(F.struct("point_id", "lat", "lon")))
    return view(spark, d, "geo").groupBy(F.floor(F.col("point_id") / 50).alias("g")).agg(F.transform(p, lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("p"))


LEG = "2 * 6371.0088 * asin(sqrt(least(pow(sin(radians(p[i + 1].lat - p[i].lat) / 2), 2) + cos(radians(p[i].lat)) * cos(radians(p[i + 1].lat)) * pow(sin(radians(p[i + 1].lon - p[i].lon) / 2), 2), 1.0)))"


@query("n_path_length", PATHS + f" SELECT g, {q6('1000 * coalesce(list_sum(list_transform(range(1, len(p)), lambda i: ' + LEG + ')), 0)', 3)} AS length_m FROM g")
def path_length(spark, d):
    return _paths(spark, d).select("g", r6(measure.path_length_m(F.col("p")), 3).alias("length_m"))


@query("n_polygon_area", PATHS + f""" SELECT g, CASE WHEN len(p) > 2 THEN round(abs(list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i].lon * p[i % len(p) + 1].lat - p[i % len(p) + 1].lon * p[i].lat))) / 2 * {measure.DEGREE_M ** 2!r}::DOUBLE * cos(radians(list_sum(list_transform(p, lambda q: q.lat)) / len(p))) / 1e6, 1) + 0.0::DOUBLE ELSE 0.0 END AS area_km2 FROM g""")
def polygon_area(spark, d):
    return _paths(spark, d).select("g", r6(measure.polygon_area_m2(F.col("p")) / 1e6, 1).alias("area_km2"))


@query("n_circle", ctes("geo") + f""", c AS (SELECT point_id, lat, lon, value + 10 AS r, unnest(range(16)) AS i FROM geo) SELECT point_id, i, {q6(f"lat + r * sin({2 * math.pi!r}::DOUBLE * i / 16) / {measure.DEGREE_M!r}::DOUBLE", 6)} AS lat, {q6(f"lon + r * cos({2 * math.pi!r}::DOUBLE * i / 16) / ({measure.DEGREE_M!r}::DOUBLE * cos(radians(lat)))", 6)} AS lon FROM c""")
def circle(spark, d):
    c = view(spark, d, "geo").select("point_id", F.posexplode(measure.circle(F.col("lat"), F.col("lon"), F.col("value") + 10)).alias("i", "p"))
    return c.select("point_id", F.col("i").cast("long").alias("i"), r6("p.lat").alias("lat"), r6("p.lon").alias("lon"))


STOPS = [10.0, 20.0, 20.0, 60.0, 200.0]


@query("n_colour_scale", ctes("geo") + f""", s AS (SELECT point_id, CASE WHEN value <= 10 THEN 0.0 WHEN value >= 200 THEN 1.0 WHEN value >= 60 THEN (3 + (value - 60) / 140) / 4 WHEN value >= 20 THEN (2 + (value - 20) / 40) / 4 ELSE (value - 10) / 10 / 4 END AS place, (value - 5) / 300 AS lin FROM geo),
c AS (SELECT point_id, place, least(floor(greatest(0, least(1, lin)) * 2), 1) AS k, greatest(0, least(1, lin)) * 2 AS u FROM s)
SELECT point_id, {q6("place", 9)} AS place, printf('#%02x%02x%02x', CAST(round(CASE WHEN k = 0 THEN 10 * (1 - u) + 200 * u ELSE 200 * (2 - u) + 30 * (u - 1) END) AS INT), CAST(round(CASE WHEN k = 0 THEN 20 * (1 - u) + 90 * u ELSE 90 * (2 - u) + 240 * (u - 1) END) AS INT), CAST(round(CASE WHEN k = 0 THEN 250 * (1 - u) + 0 * u ELSE 77 * (u - 1) END) AS INT)) AS colour FROM c""")  # fmt: skip
def colour(spark, d):
    v = F.col("value")
    anchors = [(10, 20, 250), (200, 90, 0), (30, 240, 77)]
    return view(spark, d, "geo").select("point_id", r6(measure.scale_position(v, 0, 1, STOPS), 9).alias("place"), measure.scale_colour(measure.scale_position(v, 5.0, 305.0), anchors).alias("colour"))


@query("c_korea_projection", ctes("geo") + f"""SELECT point_id, CASE WHEN lon < 126 THEN 5185 WHEN lon < 128 THEN 5186 WHEN lon < 130 THEN 5187 ELSE 5188 END AS belt, 5179 AS unified, CASE WHEN lon < 126 THEN 32651 ELSE 32652 END AS zone, {q6("value - 30")} AS ground FROM geo""")
def korea(spark, d):
    lon = F.col("lon")
    return view(spark, d, "geo").select("point_id", geo.korea_epsg("korea2010", lon).alias("belt"), geo.korea_epsg("korea_utm", lon).alias("unified"), geo.korea_epsg("utm", lon).alias("zone"), r6(geo.ground_elevation(F.col("value"), 30.0)).alias("ground"))


@query("d_moving_seconds", ctes("track") + f""", m AS (SELECT *, count(*) OVER (PARTITION BY source_file_index) AS n FROM track) SELECT point_id, {q6("avg(mag_raw) OVER (PARTITION BY source_file_index ORDER BY t, point_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")} AS smoothed FROM m""")
def moving_seconds(spark, d):
    return series.moving_seconds(view(spark, d, "track"), "mag_raw", 3.0, "t", ["source_file_index"], ["t", "point_id"]).select("point_id", r6("smoothed").alias("smoothed"))


@query("d_noise_summary", ctes("survey") + f""", d AS (SELECT line_id, {_diff(4)} AS d4, {_diff(8)} AS d8 FROM survey), l AS (SELECT line_id, sqrt(avg(d4 * d4)) AS a, sqrt(avg(d8 * d8)) AS b FROM d GROUP BY line_id HAVING count(*) >= 10)
SELECT count(*) AS n_lines, {q6("sqrt(avg(a * a))", 4)} AS overall4, {q6("sqrt(avg(b * b))", 4)} AS overall8, CAST(coalesce(sum(CASE WHEN a > 3 * (SELECT median(a) FROM l) THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_noisy FROM l""")  # fmt: skip
def noise_summary(spark, d):
    q = series.noise_summary(series.difference_qc(view(spark, d, "survey"), "mag_raw", "line_id", ORDER))
    return q.select("n_lines", r6("overall4", 4).alias("overall4"), r6("overall8", 4).alias("overall8"), "n_noisy")


BASE_DONE = ctes("survey") + f""", r AS (SELECT *, abs(mag_raw - median(mag_raw) {OVER.format(h=5)}) AS r FROM survey), b0 AS (SELECT line_id, median(r) AS base, count(*) AS n FROM r GROUP BY line_id),
c AS (SELECT r.*, n, CASE WHEN r <= 1.5 * base THEN 1 ELSE 0 END AS calm FROM r JOIN b0 USING (line_id)),
g AS (SELECT *, sum(calm) OVER (PARTITION BY line_id ORDER BY s ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) = 5 AS go, sum(calm) OVER (PARTITION BY line_id ORDER BY s ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 AS stop FROM c),
e AS (SELECT line_id, min(s) FILTER (go) AS a, max(s) FILTER (stop) AS b FROM g GROUP BY line_id),
k AS (SELECT point_id, line_id, s, mag_raw FROM g JOIN e USING (line_id) WHERE s BETWEEN least(coalesce(a, 1), floor(n * 0.2) + 1) AND greatest(coalesce(b, n), n - floor(n * 0.2))),
m AS (SELECT *, median(mag_raw) {OVER.format(h=5)} AS ma, median(mag_raw) {OVER.format(h=7)} AS mb, count(*) OVER (PARTITION BY line_id) AS n, coalesce(abs(mag_raw - lag(mag_raw) {W}) > 5, FALSE) OR coalesce(abs(lead(mag_raw) {W} - mag_raw) > 5, FALSE) AS steep FROM k),
z AS (SELECT *, 1.4826 * median(abs(mag_raw - ma)) {OVER.format(h=5)} AS sa, 1.4826 * median(abs(mag_raw - mb)) {OVER.format(h=7)} AS sb FROM m),
d AS (SELECT *, CASE WHEN steep THEN mb ELSE ma END AS med, CASE WHEN steep THEN sb ELSE sa END AS sig FROM z),
done AS (SELECT point_id, CASE WHEN n >= 5 AND sig > 0 AND abs(mag_raw - med) > 5 * sig THEN med ELSE mag_raw END AS mag FROM d)"""


def _processed(spark, d):
    return series.process_base(view(spark, d, "survey"), "mag_raw", LINE, ORDER, 11, 5, trim_k=1.5)


@query("d_process_base", BASE_DONE + f" SELECT point_id, {q6('mag')} AS mag FROM done")
def process_base(spark, d):
    return _processed(spark, d).select("point_id", r6("mag_raw").alias("mag"))


@query("f_base_series", BASE_DONE + f" SELECT 'raw' AS kind, t, {q6('mag_raw')} AS mag FROM survey UNION ALL SELECT 'corrected', t, {q6('mag')} FROM done JOIN survey USING (point_id)")
def base_series(spark, d):
    named = lambda df: df.select("t", F.col("mag_raw").alias("mag"))
    return timejoin.base_series(named(view(spark, d, "survey")), named(_processed(spark, d))).withColumn("mag", r6("mag"))


@query("f_bridged_minutes", ctes("observed") + f""", m AS (SELECT iaga_code, CAST(floor(t / 60) AS BIGINT) // 7 AS minute, avg(mag) AS mag FROM observed GROUP BY 1, 2), l AS (SELECT *, lead(minute) OVER w AS nm, lead(mag) OVER w AS nv FROM m WINDOW w AS (PARTITION BY iaga_code ORDER BY minute)),
e AS (SELECT *, unnest(range(minute, CASE WHEN nm - minute - 1 BETWEEN 1 AND 5 THEN nm ELSE minute + 1 END)) AS q FROM l) SELECT iaga_code, q AS minute, {q6("CASE WHEN q = minute THEN mag ELSE mag + (nv - mag) * (q - minute) / (nm - minute) END")} AS mag FROM e""")  # fmt: skip
def bridged_minutes(spark, d):
    o = view(spark, d, "observed").withColumn("t", F.floor(F.floor(F.col("t") / 60) / 7) * 60.0)
    return timejoin.bridged_minutes(o).select("iaga_code", "minute", r6("mag").alias("mag"))


@query("a_neighbour_days", ctes("base") + """, r AS (SELECT *, CAST(floor(t / 86400) AS BIGINT) AS d FROM base), c AS (SELECT d, count(DISTINCT floor(t / 60)) / 1440.0 AS cov FROM r GROUP BY d), w AS (SELECT unnest(range((SELECT min(d) FROM r) - 1, (SELECT max(d) FROM r) + 2)) AS day),
k AS (SELECT day, o, day + o AS d, cov, max(CASE WHEN o = 0 THEN coalesce(cov, 0) END) OVER (PARTITION BY day) AS own FROM w, (SELECT unnest([0, -1, 1]) AS o) LEFT JOIN c ON c.d = day + o),
p AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY CASE WHEN own >= 0.045 THEN abs(o) ELSE 0 END, cov DESC NULLS LAST, abs(o), o) AS n FROM k) SELECT p.day, r.t + (p.day - p.d) * 86400 AS t, mag, o <> 0 AS substitute FROM p JOIN r ON r.d = p.d WHERE n = 1""")  # fmt: skip
def neighbour_days(spark, d):
    b = view(spark, d, "base")
    ends = b.agg(F.min(F.floor(F.col("t") / 86400)).alias("a"), F.max(F.floor(F.col("t") / 86400)).alias("b"))
    return timejoin.with_neighbour_days(b, ends.select(F.explode(F.sequence(F.col("a") - 1, F.col("b") + 1)).alias("day")), 0.045)


PASSED = ctes("survey") + f""", ps AS (SELECT line_id, {PMOD.format(x="degrees(0.5 * atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)))", m=180)} AS ax, avg(x) AS cx, avg(y) AS cy FROM survey GROUP BY line_id),
lk AS (SELECT a.line_id AS a, b.line_id AS b FROM ps a JOIN ps b ON a.line_id <> b.line_id AND abs((a.ax - b.ax + 90) - 180 * floor((a.ax - b.ax + 90) / 180) - 90) <= 10 AND abs(-(b.cx - a.cx) * sin(radians(a.ax)) + (b.cy - a.cy) * cos(radians(a.ax))) <= 60 AND abs(-(b.cx - a.cx) * sin(radians(b.ax)) + (b.cy - a.cy) * cos(radians(b.ax))) <= 60 WHERE a.line_id // 5 = b.line_id // 5)"""


@query("g_pass_groups", PASSED.replace("WITH ", "WITH RECURSIVE ", 1).replace(" WHERE a.line_id // 5 = b.line_id // 5", "") + ", c AS (SELECT line_id AS id, line_id AS t FROM ps UNION SELECT c.id, lk.b FROM c JOIN lk ON c.t = lk.a) SELECT id AS line_id, min(t) AS grp FROM c GROUP BY id")
def pass_groups(spark, d):
    return leveling.pass_groups(leveling.line_passes(view(spark, d, "survey"), "mag_raw"), 60.0, 10.0)


TWINS = EVEN + f""", g AS (SELECT *, line_id // 2 AS grp, x * cos(radians(90)) + y * sin(radians(90)) AS along FROM survey), q AS (SELECT line_id, sqrt(avg(d * d)) AS rough FROM (SELECT line_id, {_diff(4).replace("ORDER BY s", "ORDER BY t, point_id")} AS d FROM survey) GROUP BY line_id),
e AS (SELECT grp, line_id, min(along) AS a, max(along) AS b FROM g GROUP BY 1, 2), k AS (SELECT grp, max(a) AS lo, min(b) AS hi, count(*) AS n FROM e GROUP BY grp HAVING count(*) > 1),
b AS (SELECT grp, arg_min(line_id, (rough, line_id)) AS keep FROM e JOIN q USING (line_id) GROUP BY grp)"""


def _twins(spark, d):
    s = _evened(spark, d)
    return s, s.select("line_id", F.floor(F.col("line_id") / 2).cast("int").alias("grp")).distinct()


@query("g_duplicates", TWINS + " SELECT point_id, coalesce(line_id <> keep AND along BETWEEN lo AND hi, FALSE) AS is_duplicate FROM g LEFT JOIN b USING (grp) LEFT JOIN k USING (grp)")
def duplicates(spark, d):
    s, groups = _twins(spark, d)
    return leveling.resolve_duplicates(s, "mag_raw", groups, 90.0).select("point_id", "is_duplicate")


@query("g_repeatability", ctes("survey") + f""", w AS (SELECT line_id, CAST(sign(arg_max(y, (t, point_id)) - arg_min(y, (t, point_id))) AS INT) AS dir FROM survey GROUP BY 1),
b AS (SELECT line_id // 4 AS grp, line_id, dir, CAST(floor(abs(y) / 40) AS BIGINT) AS bin, avg(mag_raw) AS v FROM survey JOIN w USING (line_id) GROUP BY 1, 2, 3, 4), m AS (SELECT *, v - avg(v) OVER p AS d, count(*) OVER p AS n FROM b WINDOW p AS (PARTITION BY grp, dir, bin)),
s AS (SELECT grp, stddev_pop(d) AS sigma, count(*) AS n FROM m WHERE n > 1 GROUP BY grp), h AS (SELECT grp, bin, avg(v) FILTER (dir > 0) AS f, avg(v) FILTER (dir < 0) AS r FROM b GROUP BY 1, 2), e AS (SELECT grp, avg(abs(f - r)) AS heading_error FROM h WHERE f IS NOT NULL AND r IS NOT NULL GROUP BY grp)
SELECT grp, {q6("sigma")} AS sigma, n, {q6("heading_error")} AS heading_error FROM s FULL JOIN e USING (grp)""")  # fmt: skip
def repeatability(spark, d):
    s = view(spark, d, "survey")
    groups = s.select("line_id", F.floor(F.col("line_id") / 4).cast("int").alias("grp")).distinct()
    directions = leveling.line_passes(s, "mag_raw").select("line_id", "direction")
    # all lines run over the same stretch once their direction is known
    even = s.withColumn("y", F.abs("y"))
    got = leveling.repeat_deviation(even, "mag_raw", groups, 90.0, 40.0, directions)
    return got.select("grp", r6("sigma").alias("sigma"), "n", r6("heading_error").alias("heading_error"))


@query("g_apply_shifts", ctes("survey") + f" SELECT point_id, {q6('mag_raw - CASE WHEN line_id % 3 = 0 THEN 0 ELSE line_id / 8.0::DOUBLE + line_id / 1024.0::DOUBLE * s END')} AS leveled FROM survey")
def apply_shifts(spark, d):
    s = view(spark, d, "survey")
    shifts = s.filter("line_id % 3 > 0").select("line_id").distinct().select("line_id", (F.col("line_id") / 8).alias("shift"), (F.col("line_id") / 1024).alias("slope"))
    return leveling.apply_shifts(s, shifts, "mag_raw").select("point_id", r6("leveled").alias("leveled"))


@query("g_calibration_coverage", ctes("track") + " SELECT min(x) AS theta_min, max(x) AS theta_max, min(y) AS phi_min, max(y) AS phi_max FROM track")
def calibration_coverage(spark, d):
    return leveling.angular_coverage(view(spark, d, "track").select(F.col("x").alias("theta"), F.col("y").alias("phi")))


@query("g_heading_reliable", ctes("track") + ", o AS (SELECT point_id, CASE WHEN point_id % 5 > 0 THEN mag_raw % 7 - 3 END AS off, mag_raw % 5 AS spread FROM track) SELECT point_id, coalesce(abs(off) > spread, FALSE) AS apply FROM o")
def heading_reliable(spark, d):
    o = view(spark, d, "track").select("point_id", F.when(F.col("point_id") % 5 > 0, F.col("mag_raw") % 7 - 3).alias("offset"), (F.col("mag_raw") % 5).alias("spread"))
    return leveling.heading_is_reliable(o).select("point_id", "apply")


@query("h_sample_grid", ctes("survey", "grid") + """, a AS (SELECT point_id, CAST(ceil(abs(y) % 170 / 10 - 0.5) AS INT) AS row, CAST(ceil(mag_raw % 170 / 10 - 0.5) AS INT) AS col FROM survey) SELECT point_id, round(value, 6) + 0.0::DOUBLE AS sampled FROM a LEFT JOIN grid USING (row, col)""")
def sample(spark, d):
    p = view(spark, d, "survey").select("point_id", (F.col("mag_raw") % 170).alias("x"), (F.abs("y") % 170).alias("y"))
    return spatial.sample_grid(p, view(spark, d, "grid"), 0.0, 0.0, 10.0).select("point_id", r6("sampled").alias("sampled"))


@query("h_proximity", ctes("grid", "survey") + f""", f AS (SELECT DISTINCT x, y FROM survey WHERE s % 40 = 1 AND line_id < 4) SELECT g.row, g.col, {q6("exp(-min(sqrt(pow(g.easting - f.x, 2) + pow(g.northing - f.y, 2))) / 200)")} AS score FROM grid g, f GROUP BY g.row, g.col""")
def proximity(spark, d):
    cells = view(spark, d, "grid").select("row", "col", F.col("easting").alias("x"), F.col("northing").alias("y"))
    features = view(spark, d, "survey").filter("s % 40 = 1 and line_id < 4").select(F.col("x").alias("x2"), F.col("y").alias("y2")).distinct()
    return interpretation.proximity_scores(cells, features).select("row", "col", r6("score").alias("score"))


@query("h_densify", ctes("survey") + f""", l AS (SELECT line_id, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS d FROM (SELECT line_id, s, x + mag_raw % 9 AS x, y FROM survey) WINDOW w AS (PARTITION BY line_id ORDER BY s)),
c AS (SELECT *, row_number() OVER (PARTITION BY line_id) AS r FROM l), q AS (SELECT line_id, s, x + mag_raw % 9 AS x, y FROM survey), d AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS d FROM q WINDOW w AS (PARTITION BY line_id ORDER BY s)),
e AS (SELECT *, sum(d) OVER (PARTITION BY line_id ORDER BY s) AS s0 FROM d), f AS (SELECT line_id, x, y, s0, lead(s0) OVER w AS s1, lead(x) OVER w AS x1, lead(y) OVER w AS y1, max(s0) OVER (PARTITION BY line_id) AS top FROM e WINDOW w AS (PARTITION BY line_id ORDER BY s)),
k AS (SELECT *, unnest(range(CAST(ceil(s0 / 7) AS BIGINT), CAST(ceil(s1 / 7) AS BIGINT) + 1)) * 7.0::DOUBLE AS q FROM f WHERE s1 > s0)
SELECT line_id AS path_id, q AS s, {q6("x + (q - s0) / (s1 - s0) * (x1 - x)")} AS x, {q6("y + (q - s0) / (s1 - s0) * (y1 - y)")} AS y FROM k WHERE q >= s0 AND (q < s1 OR (q = s1 AND s1 = top))""")  # fmt: skip
def densify(spark, d):
    p = view(spark, d, "survey").select(F.col("line_id").alias("path_id"), F.col("s").alias("seq"), (F.col("x") + F.col("mag_raw") % 9).alias("x"), "y")
    return spatial.densify(p, 7.0).select("path_id", "s", r6("x").alias("x"), r6("y").alias("y"))


SEGMENTS = [(100.0, -200.0, 700.0, 300.0), (0.0, 50.0, 1900.0, 50.0), (400.0, 400.0, 400.0, 400.0)]


def _segment_sql(ax: float, ay: float, bx: float, by: float) -> str:
    size = (bx - ax) ** 2 + (by - ay) ** 2
    t = f"greatest(0.0, least(1.0, ((x - {ax}) * {bx - ax} + (y - {ay}) * {by - ay}) / {size}))" if size else "0.0"
    return f"sqrt(pow(x - {ax} - {t} * {bx - ax}, 2) + pow(y - {ay} - {t} * {by - ay}, 2)) <= 35"


@query("h_near_segments", ctes("survey") + " SELECT point_id, " + " OR ".join(_segment_sql(*s) for s in SEGMENTS) + " AS near FROM survey")
def near_segments(spark, d):
    seg = spark.createDataFrame(SEGMENTS, "ax double, ay double, bx double, by double")
    return spatial.near_segments(view(spark, d, "survey").select("point_id", "x", "y"), "point_id", seg, 35.0).select("point_id", "near")


SQUARES = [(1, 0.4, [(5.0, 5.0), (95.0, 5.0), (95.0, 95.0), (5.0, 95.0)]), (2, 0.9, [(45.0, 25.0), (155.0, 25.0), (155.0, 125.0), (45.0, 125.0)])]


@query("h_classify_cells", ctes("grid") + " SELECT row, col, CASE WHEN easting BETWEEN 45 AND 154 AND northing BETWEEN 25 AND 124 THEN 0.9 WHEN easting BETWEEN 5 AND 94 AND northing BETWEEN 5 AND 94 THEN 0.4 END::DOUBLE AS chi FROM grid")
def classify_cells(spark, d):
    cells = view(spark, d, "grid").select("row", "col", F.col("easting").alias("x"), F.col("northing").alias("y"))
    polygons = spark.createDataFrame([(i, c, [{"x": x, "y": y} for x, y in r]) for i, c, r in SQUARES], "polygon_id int, chi double, path array<struct<x:double,y:double>>")
    return spatial.classify_cells(cells, polygons, "chi", 50.0).select("row", "col", "chi")


@query("h_keep_inside", ctes("grid") + f" SELECT row, col, CASE WHEN (easting BETWEEN 5 AND 94 AND northing BETWEEN 5 AND 94) OR (easting BETWEEN 45 AND 154 AND northing BETWEEN 25 AND 124) THEN {q6('value')} END AS value FROM grid")
def keep_inside(spark, d):
    return spatial.keep_inside(view(spark, d, "grid"), [r for _, _, r in SQUARES]).select("row", "col", r6("value").alias("value"))


MARGIN = ctes("grid") + """, g AS (SELECT row, col, CASE WHEN (row * 7 + col * 3) % 29 > 0 THEN value END AS v FROM grid), m AS (SELECT g.row, g.col, g.v, g.v IS NOT NULL AND (least(g.row, 15 - g.row, g.col, 15 - g.col) + 1 <= 1.5 OR EXISTS (SELECT 1 FROM g e WHERE e.v IS NULL AND sqrt(pow(e.row - g.row, 2) + pow(e.col - g.col, 2)) <= 1.5)) AS in_margin FROM g)"""


def _marked(spark, d):
    g = view(spark, d, "grid").withColumn("value", F.when((F.col("row") * 7 + F.col("col") * 3) % 29 > 0, F.col("value")))
    return spatial.edge_margin(g, 10.0, 15.0)


@query("h_edge_margin", MARGIN + " SELECT row, col, in_margin FROM m")
def edge_margin(spark, d):
    return _marked(spark, d).select("row", "col", "in_margin")


@query("h_mask_margin", MARGIN + f" SELECT row, col, CASE WHEN NOT in_margin THEN {q6('v')} END AS value FROM m")
def mask_margin(spark, d):
    return spatial.mask_margin(_marked(spark, d)).select("row", "col", r6("value").alias("value"))


@query("i_grid_overlay", ctes("grid") + f", g AS (SELECT CASE WHEN (row + col) % 5 > 0 THEN value END AS v FROM grid) SELECT count(*) AS n_cells, {q6('100.0::DOUBLE * (1 - count(v) / count(*))')} AS gap_pct, {q6('min(v)')} AS min, {q6('max(v)')} AS max, {q6('avg(v)')} AS mean, {q6('stddev_samp(v)')} AS std, {q6('quantile_cont(v, 0.02)')} AS low, {q6('quantile_cont(v, 0.98)')} AS high FROM g")
def overlay(spark, d):
    g = view(spark, d, "grid").withColumn("value", F.when((F.col("row") + F.col("col")) % 5 > 0, F.col("value")))
    return stats.grid_overlay(g).select("n_cells", *[r6(c).alias(c) for c in ("gap_pct", "min", "max", "mean", "std", "low", "high")])


EDGE = """, d AS (SELECT k, row, col, value * (1 + k * ((row * 5 + col * 3) % 7) / 8.0) AS v FROM grid, (SELECT unnest(range(3)) AS k)), c AS (SELECT k, quantile_cont(v, 0.6) AS p FROM d GROUP BY k),
e AS (SELECT d.k, row, col, v FROM d JOIN c USING (k) WHERE v >= p AND NOT EXISTS (SELECT 1 FROM d h WHERE h.k = d.k AND h.row BETWEEN d.row - 1 AND d.row + 1 AND h.col BETWEEN d.col - 1 AND d.col + 1 AND h.v > d.v))"""


def _edges(spark, d):
    g = view(spark, d, "grid").withColumn("grid_id", F.explode(F.array(*map(F.lit, range(3)))))
    g = g.withColumn("value", F.col("value") * (1 + F.col("grid_id") * ((F.col("row") * 5 + F.col("col") * 3) % 7) / 8.0))
    return interpretation.edge_points(g, 60.0)


@query("k_edge_points", ctes("grid") + EDGE + f" SELECT CAST(k AS INT) AS grid_id, row, col, {q6('v')} AS value FROM e")
def edge_points(spark, d):
    return _edges(spark, d).select("grid_id", "row", "col", r6("value").alias("value"))


@query("k_persistent_edges", ctes("grid") + EDGE + ", p AS (SELECT a.row, a.col, count(DISTINCT b.k) / 3.0::DOUBLE AS persistence FROM e a JOIN e b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 WHERE a.k = 0 GROUP BY 1, 2) SELECT row, col, round(persistence, 6) AS persistence FROM p WHERE persistence >= 0.5")
def persistent(spark, d):
    return interpretation.persistent(_edges(spark, d), 3).select("row", "col", F.round("persistence", 6).alias("persistence"))


@query("k_rose", ctes("survey") + ", s AS (SELECT mag_raw % 180 AS a, abs(y) AS l FROM survey) SELECT floor(a / 10) * 10 AS bin_deg, count(*) AS n, round(sum(l), 4) AS length_m FROM s GROUP BY 1")
def rose(spark, d):
    s = view(spark, d, "survey").select((F.col("mag_raw") % 180).alias("strike_deg"), F.abs("y").alias("length_m"))
    return interpretation.rose(s).select(F.col("bin_deg").cast("double").alias("bin_deg"), "n", F.round("length_m", 4).alias("length_m"))


BEST = ctes("grid").replace("WITH ", "WITH RECURSIVE ", 1) + """, t AS (SELECT row, col, easting AS x, northing AS y, value AS score, row_number() OVER (ORDER BY value DESC, row, col) AS o FROM grid g WHERE value >= 50 AND NOT EXISTS (SELECT 1 FROM grid h WHERE h.row BETWEEN g.row - 1 AND g.row + 1 AND h.col BETWEEN g.col - 1 AND g.col + 1 AND h.value > g.value)),
l AS (SELECT list({'o': o, 'x': x, 'y': y} ORDER BY o) AS t FROM t), k AS (SELECT list_reduce(list_transform(t, lambda e: [e]), lambda kept, e: CASE WHEN len(list_filter(kept, lambda q: sqrt(pow(q.x - e[1].x, 2) + pow(q.y - e[1].y, 2)) < 35)) > 0 THEN kept ELSE list_concat(kept, e) END) AS kept FROM l),
u AS (SELECT unnest(kept).o AS o FROM k)"""


@query("k_spaced_best", BEST + f" SELECT row, col, {q6('score')} AS score, CAST(row_number() OVER (ORDER BY o) AS INT) AS rank FROM t JOIN u USING (o) ORDER BY o LIMIT 20")
def spaced_best(spark, d):
    g = view(spark, d, "grid").select("row", "col", F.col("easting").alias("x"), F.col("northing").alias("y"), F.col("value").alias("score"))
    return interpretation.spaced_best(g, 50.0, 35.0).select("row", "col", r6("score").alias("score"), "rank")


@query("l_base_summary", ctes("base") + " SELECT count(*) AS n_points, min(t) AS t_start, max(t) AS t_end, min(mag) AS mag_min, max(mag) AS mag_max, count(t) - count(DISTINCT t) AS n_repeated FROM base")
def base_summary(spark, d):
    return stats.base_summary(view(spark, d, "base"))


@query("l_exclusion_counts", EDITED + f", r AS (SELECT CASE WHEN line >= 0 THEN 'kept' ELSE coalesce(reason, 'other') END AS reason FROM p) SELECT reason, count(*) AS n, {q6('100.0::DOUBLE * count(*) / (SELECT count(*) FROM r)')} AS pct FROM r GROUP BY reason")
def exclusion_counts(spark, d):
    return stats.exclusion_counts(_edited(spark, d)).select("reason", "n", r6("pct").alias("pct"))


@query("h_keep_polygon", ctes("survey") + f" SELECT point_id, ({EDGES}) % 2 = 1 AS inside FROM survey")
def polygon_flags(spark, d):
    return view(spark, d, "survey").select("point_id", spatial.inside_polygon(F.col("x"), F.col("y"), RING).alias("inside"))


@query("i_cell_advice", ctes("survey") + ", s AS (SELECT point_id, mag_raw % 60 + 1 AS gap, mag_raw % 13 + 1 AS cell FROM survey) SELECT point_id, greatest(2 * cell, 1.2 * gap) AS radius FROM s")
def cell_advice(spark, d):
    s = view(spark, d, "survey").select("point_id", (F.col("mag_raw") % 60 + 1).alias("gap"), (F.col("mag_raw") % 13 + 1).alias("cell"))
    return s.select("point_id", gridding.auto_radius_of(F.col("cell"), F.col("gap")).alias("radius"))


@query("a_bilinear", ctes("survey", "grid") + f""", a AS (SELECT point_id, mag_raw % 170 / 10 AS fx, abs(y) % 170 / 10 AS fy FROM survey), k AS (SELECT point_id, CAST(floor(fy) AS INT) + i AS row, CAST(floor(fx) AS INT) + j AS col,
  (CASE WHEN i = 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END) * (CASE WHEN j = 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END) AS w FROM a, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))
SELECT point_id, CASE WHEN count(*) = count(value) THEN {q6("sum(w * value)")} END AS sampled FROM k LEFT JOIN grid USING (row, col) WHERE w > 0 GROUP BY point_id""")  # fmt: skip
def bilinear(spark, d):
    p = view(spark, d, "survey").select("point_id", (F.col("mag_raw") % 170).alias("x"), (F.abs("y") % 170).alias("y"))
    return spatial.bilinear(p, view(spark, d, "grid"), 0.0, 0.0, 10.0).select("point_id", r6("sampled").alias("sampled"))


@query("h_structures", ctes("survey") + f" SELECT point_id AS cell_id, CASE WHEN {_segment_sql(*SEGMENTS[0])} OR {_segment_sql(*SEGMENTS[2])} THEN 'building' WHEN {_segment_sql(*SEGMENTS[1]).replace('<= 35', '<= 20')} THEN 'road' END AS structure FROM survey")
def structures(spark, d):
    paths = spark.createDataFrame([("building", *SEGMENTS[0]), ("road", *SEGMENTS[1]), ("building", *SEGMENTS[2])], "kind string, ax double, ay double, bx double, by double")
    return spatial.near_structures(view(spark, d, "survey").select(F.col("point_id").alias("cell_id"), "x", "y"), paths, 35.0, 20.0).select("cell_id", "structure")


@query("j_continuation_report", ctes("grid") + f" SELECT count(*) FILTER (row % 3 > 0) AS n_known, count(*) FILTER (row % 3 = 0) AS n_gaps, {q6('100.0::DOUBLE * count(*) FILTER (row % 3 = 0) / count(*)')} AS gap_pct, CASE WHEN count(*) FILTER (row % 3 > 0) < 400 THEN 'too few known cells' WHEN count(*) FILTER (row % 3 = 0) = 0 THEN 'no gaps' END AS reason, count(*) FILTER (row % 3 > 0) >= 400 AND count(*) FILTER (row % 3 = 0) > 0 AS applicable FROM grid")
def continuation(spark, d):
    g = view(spark, d, "grid").withColumn("value", F.when(F.col("row") % 3 > 0, F.col("value")))
    return stats.continuation_report(g).withColumn("gap_pct", r6("gap_pct"))


@query("f_preview_series", ctes("observed") + f" SELECT iaga_code, count(*) AS n, min(t) AS t_start, max(t) AS t_end, min(mag) AS mag_min, max(mag) AS mag_max, count(DISTINCT floor(t / 86400)) AS n_days, {q6('count(DISTINCT floor(t / 60)) / (1440.0::DOUBLE * count(DISTINCT floor(t / 86400)))')} AS coverage FROM observed GROUP BY iaga_code")
def preview(spark, d):
    return timejoin.preview_series(view(spark, d, "observed")).withColumn("coverage", r6("coverage"))


@query("f_substitute_base", ctes("observed") + " SELECT t, min(mag) AS mag FROM observed WHERE iaga_code = (SELECT min(iaga_code) FROM observed) GROUP BY t")
def substitute(spark, d):
    o = view(spark, d, "observed")
    return timejoin.substitute_base(o, o.agg(F.min("iaga_code")).first()[0])


@query("g_run_repeatability", ctes("survey") + f""", w AS (SELECT line_id, CAST(sign(arg_max(y2, (t, point_id)) - arg_min(y2, (t, point_id))) AS INT) AS dir FROM (SELECT *, CASE WHEN line_id % 2 = 0 THEN s * 5.0::DOUBLE ELSE (500 - s) * 5.0::DOUBLE END AS y2 FROM survey) GROUP BY 1),
b AS (SELECT line_id // 4 * 4 AS grp, line_id, dir, CAST(floor((x * cos(radians(90)) + (CASE WHEN line_id % 2 = 0 THEN s * 5.0::DOUBLE ELSE (500 - s) * 5.0::DOUBLE END) * sin(radians(90))) / 40) AS BIGINT) AS bin, avg(mag_raw) AS v FROM survey JOIN w USING (line_id) GROUP BY 1, 2, 3, 4), m AS (SELECT *, v - avg(v) OVER p AS d, count(*) OVER p AS n FROM b WINDOW p AS (PARTITION BY grp, dir, bin)),
s AS (SELECT grp, stddev_pop(d) AS sigma, count(*) AS n FROM m WHERE n > 1 GROUP BY grp), h AS (SELECT grp, bin, avg(v) FILTER (dir > 0) AS f, avg(v) FILTER (dir < 0) AS r FROM b GROUP BY 1, 2), e AS (SELECT grp, avg(abs(f - r)) AS heading_error FROM h WHERE f IS NOT NULL AND r IS NOT NULL GROUP BY grp)
SELECT grp, {q6("sigma")} AS sigma, n, {q6("heading_error")} AS heading_error, 4 AS n_passes FROM s FULL JOIN e USING (grp)""")  # fmt: skip
def run_repeatability(spark, d):
    """Four passes each of ten lines, 200 m apart, flown to and fro."""
    s = view(spark, d, "survey").withColumn("y", F.when(F.col("line_id") % 2 == 0, F.col("s") * 5.0).otherwise((500 - F.col("s")) * 5.0)).withColumn("x", F.floor(F.col("line_id") / 4) * 200.0)
    got = leveling.run_repeatability(s, "mag_raw", 90.0, 40.0, 60.0)
    return got.select("grp", r6("sigma").alias("sigma"), "n", r6("heading_error").alias("heading_error"), F.col("n_passes").cast("int").alias("n_passes"))


@query("l_extrema_places", ctes("grid") + """, p AS (SELECT *, 36 + northing / 100000 AS lat, 127 + easting / 100000 AS lon FROM grid) (SELECT 'max' AS kind, lat, lon, round(value, 6) + 0.0::DOUBLE AS value FROM p ORDER BY p.value DESC, row, col LIMIT 1) UNION ALL (SELECT 'min', lat, lon, round(value, 6) + 0.0::DOUBLE FROM p ORDER BY p.value, row, col LIMIT 1)""")
def extrema_places(spark, d):
    got = stats.places(stats.extrema(view(spark, d, "grid")), 36 + F.col("northing") / 100000, 127 + F.col("easting") / 100000)
    return got.select("kind", "lat", "lon", r6("value").alias("value"))


@query("k_score_overlay", ctes("grid") + f", s AS (SELECT 1 / (1 + exp(-(value - 55))) AS v FROM grid) SELECT count(*) AS n_cells, {q6('min(v)')} AS min, {q6('max(v)')} AS max, {q6('avg(v)')} AS mean FROM s")
def score_overlay(spark, d):
    g = view(spark, d, "grid").withColumn("value", 1 / (1 + F.exp(-(F.col("value") - 55))))
    return stats.grid_overlay(g).select("n_cells", r6("min").alias("min"), r6("max").alias("max"), r6("mean").alias("mean"))


MODEL = ctes("grid") + ", m AS (SELECT row, col, CAST(k AS INT) AS layer, easting AS x, northing AS y, -5.0::DOUBLE - 10 * k AS z, value * (k + 1) / 64 AS chi FROM grid, (SELECT unnest(range(4)) AS k) WHERE (row + col + k) % 5 > 0)"


def _model(spark, d):
    g = view(spark, d, "grid").withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(3)))).filter((F.col("row") + F.col("col") + F.col("layer")) % 5 > 0)
    return g.select("row", "col", "layer", F.col("easting").alias("x"), F.col("northing").alias("y"), (-5.0 - 10 * F.col("layer")).alias("z"), (F.col("value") * (F.col("layer") + 1) / 64).alias("chi"))


@query("m_horizontal_slice", MODEL + f" SELECT row, col, CASE WHEN chi >= 1.5 AND chi <= 1.8 THEN {q6('chi')} END AS chi FROM m WHERE layer = 1")
def horizontal_slice(spark, d):
    return inversion.horizontal_slice(_model(spark, d), 1, 1.5, 1.8).select("row", "col", r6("chi").alias("chi"))


@query("m_vertical_section", MODEL + f", p AS (SELECT i * 4.0::DOUBLE AS s, i * 4.0::DOUBLE AS px, i * 2.0::DOUBLE + 7 AS py FROM (SELECT unnest(range(50)) AS i)) SELECT s, layer, z, {q6('chi')} AS chi FROM p JOIN m ON col = floor(px / 10 + 0.5) AND row = floor(py / 10 + 0.5)")
def vertical_section(spark, d):
    path = spark.range(50).select((F.col("id") * 4.0).alias("s"), (F.col("id") * 4.0).alias("x"), (F.col("id") * 2.0 + 7).alias("y"))
    return inversion.vertical_section(_model(spark, d), path, 10.0).select("s", "layer", "z", r6("chi").alias("chi"))


@query("m_box_faces", MODEL + """, t AS (SELECT *, min(layer) OVER (PARTITION BY row, col) AS top FROM m) SELECT row, col, layer, 'top' AS face FROM t WHERE layer = top + 1 UNION ALL SELECT row, col, layer, 'south' FROM t WHERE row = 0 UNION ALL SELECT row, col, layer, 'north' FROM t WHERE row = 15
  UNION ALL SELECT row, col, layer, 'west' FROM t WHERE col = 0 UNION ALL SELECT row, col, layer, 'east' FROM t WHERE col = 15""")  # fmt: skip
def box_faces(spark, d):
    return inversion.box_faces(_model(spark, d), 1).select("row", "col", "layer", "face")


@query("m_upsample", MODEL + f""", b AS (SELECT a.row, a.col, a.layer, a.x, a.y, a.z, {', '.join(f'c{i}{j}{k}.chi AS v{i}{j}{k}' for i in (0, 1) for j in (0, 1) for k in (0, 1))} FROM m a {' '.join(f'JOIN m c{i}{j}{k} ON c{i}{j}{k}.row = a.row + {i} AND c{i}{j}{k}.col = a.col + {j} AND c{i}{j}{k}.layer = a.layer + {k}' for i in (0, 1) for j in (0, 1) for k in (0, 1))}),
f AS (SELECT *, i / 2.0::DOUBLE AS fr, j / 2.0::DOUBLE AS fc, k / 2.0::DOUBLE AS fl FROM b, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j), (SELECT unnest([0, 1]) AS k))
SELECT x + 10 * fc AS x, y + 10 * fr AS y, z - 10 * fl AS z, {q6(' + '.join(f"v{i}{j}{k} * {'fr' if i else '(1 - fr)'} * {'fc' if j else '(1 - fc)'} * {'fl' if k else '(1 - fl)'}" for i in (0, 1) for j in (0, 1) for k in (0, 1)))} AS chi FROM f""")  # fmt: skip
def upsample(spark, d):
    return inversion.upsample(_model(spark, d), 2).select("x", "y", "z", r6("chi").alias("chi"))


@query("g_nearest_pair_offset", EVEN + f""", s AS (SELECT *, max(mag_raw) OVER w - min(mag_raw) OVER w AS rg FROM survey WINDOW w AS (PARTITION BY line_id ORDER BY t, point_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)), o AS (SELECT line_id, line_id % 2 AS grp, avg(-x * sin(radians(90)) + y * cos(radians(90))) AS c FROM survey GROUP BY 1, 2),
p AS (SELECT line_id, grp, lead(line_id) OVER (ORDER BY c, line_id) AS nxt, lead(grp) OVER (ORDER BY c, line_id) AS ng FROM o), k AS (SELECT a.point_id, a.line_id % 2 AS grp, a.mag_raw AS v, a.rg, b.mag_raw AS v2, row_number() OVER (PARTITION BY a.point_id ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.point_id) AS r
  FROM s a JOIN p USING (line_id) JOIN s b ON b.line_id = p.nxt AND abs(a.x - b.x) <= 75 AND abs(a.y - b.y) <= 75 WHERE grp <> ng AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 75), n AS (SELECT * FROM k WHERE r = 1)
SELECT {q6("median(CASE WHEN grp = 0 THEN v2 - v ELSE v - v2 END)")} AS "offset", count(*) AS n FROM n WHERE rg <= (SELECT quantile_cont(rg, 0.4) FROM n)""")  # fmt: skip
def nearest_pair(spark, d):
    s = _evened(spark, d).withColumn("group", F.when(F.col("line_id") % 2 == 0, "A").otherwise("B"))
    return leveling.nearest_pair_offset(s, "mag_raw", 90.0, 50.0).select(r6("offset").alias("offset"), "n")


@query("h_outline_area", ctes("survey") + """, t AS (SELECT DISTINCT floor(x / 20) AS c, floor(y / 20) AS r FROM survey), i AS (SELECT DISTINCT c + a AS c, r + b AS r FROM t, (SELECT unnest(range(-2, 3)) AS a), (SELECT unnest(range(-2, 3)) AS b) WHERE a * a + b * b <= 4) SELECT count(*) * 400.0::DOUBLE AS area_m2 FROM i""")
def outline_area(spark, d):
    return spatial.survey_outline(view(spark, d, "survey"), 40.0)[1]


@query("l_certificates", ctes("survey") + """, f AS (SELECT line_id, avg(mag_raw % 7) AS sigma_nt, CASE WHEN line_id % 4 > 0 THEN line_id / 8.0 END AS gap_pct, line_id * 1.5 AS excluded_pct FROM survey GROUP BY line_id),
v AS (SELECT line_id, CASE WHEN sigma_nt <= 5 THEN 'pass' ELSE 'fail' END AS a, CASE WHEN gap_pct IS NULL THEN 'not_evaluated' WHEN gap_pct <= 5 THEN 'pass' ELSE 'fail' END AS b, CASE WHEN excluded_pct <= 30 THEN 'pass' ELSE 'fail' END AS c FROM f)
SELECT line_id, a AS repeatability, b AS sampling_gaps, c AS excluded, 'not_evaluated' AS noise, CASE WHEN 'fail' IN (a, b, c) THEN 'fail' ELSE 'pass' END AS overall FROM v""")  # fmt: skip
def certificates(spark, d):
    f = view(spark, d, "survey").groupBy("line_id").agg(F.avg(F.col("mag_raw") % 7).alias("sigma_nt")).withColumn("gap_pct", F.when(F.col("line_id") % 4 > 0, F.col("line_id") / 8.0)).withColumn("excluded_pct", F.col("line_id") * 1.5)
    return stats.verdicts(f).select("line_id", "repeatability", "sampling_gaps", "excluded", "noise", "overall")


@query("b_point_lines", EDITED + " SELECT CAST(point_id AS VARCHAR) || ',' || CAST(mag_raw AS VARCHAR) || ',' || CAST(line AS VARCHAR) || ',' || coalesce(reason, '') || ',\"a, b\"' AS value FROM p")
def point_lines(spark, d):
    return sinks.csv_lines(_edited(spark, d).withColumn("note", F.lit("a, b")), ["point_id", "mag_raw", "line_id", "reason", "note"])


@query("b_target_lines", ctes("grid") + " SELECT CAST(row_number() OVER (ORDER BY round(value, 2) DESC, easting, northing) AS VARCHAR) || ',' || CAST(easting AS VARCHAR) || ',' || CAST(round(value, 2) AS VARCHAR) AS value FROM grid WHERE value > 56")
def target_lines(spark, d):
    t = view(spark, d, "grid").filter("value > 56").select(F.col("easting").alias("x"), F.col("northing").alias("y"), F.round("value", 2).alias("quality"))
    return sinks.csv_lines(sinks.ranked_targets(t), ["target_id", "x", "quality"])
