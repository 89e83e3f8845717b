"""Spatial joins by grid cells: nearest points, containment, components, local maxima and lookups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from . import graph

AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def _cells(df: DataFrame, size: float, x: str, y: str, spread: bool) -> DataFrame:
    cx, cy = F.floor(F.col(x) / size), F.floor(F.col(y) / size)
    if not spread:
        return df.withColumn("_cx", cx).withColumn("_cy", cy)
    near = F.array(*[F.struct((cx + i).alias("_cx"), (cy + j).alias("_cy")) for i, j in AROUND])
    return df.withColumn("_c", F.explode(near)).select("*", "_c._cx", "_c._cy").drop("_c")


def within(left: DataFrame, right: DataFrame, radius: float, spread_left: bool = False, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of left (x, y) and right (x2, y2) rows at most `radius` apart and equal in `on`, with distance d; an equi-join on cells of that
    size, of which one side is dealt to nine. Spark would judge that side by its size before and may broadcast it, so both are sorted."""
    a, b = _cells(left, radius, "x", "y", spread_left), _cells(right, radius, "x2", "y2", not spread_left)
    pairs = a.join(b.hint("merge"), ["_cx", "_cy", *on]).drop("_cx", "_cy")
    return pairs.withColumn("d", F.sqrt(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2))).filter(F.col("d") <= radius)


def _reach(left: DataFrame, right: DataFrame) -> float:
    """No left row is further from any right row."""
    both = left.select("x", "y").union(right.select("x2", "y2"))
    x0, x1, y0, y1 = both.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    return ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5 if x0 is not None and y0 is not None else 0.0


def _widening(left: DataFrame, keys: list[str], right: DataFrame, radius: float, found, enough: Column, far=None) -> DataFrame:
    """found(pairs) of every left row, one row per `keys`: the search doubles its radius for those without `enough`, until it
    covers everything. Later rounds have few rows left, which are dealt to the nine cells in place of the right side. What two rounds
    have left goes to far(rows, right, radius, reach), which gives the pairs that decide, if there is one."""
    todo, out, most, end = left.select(*keys, "x", "y"), None, _reach(left, right), 4 * radius
    while True:
        last = radius >= most
        if far and not last and radius >= end:
            return out.unionByName(written(found(far(todo, right, radius, most)), "near"))
        got = written(found(within(todo, right, radius, spread_left=out is not None)), "near")
        done = got if last else got.filter(enough)
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        todo = written(todo.join(done.select(*keys), keys, "left_anti"), "far")
        if not todo.head(1):
            return out
        radius *= 2


def nearest(left: DataFrame, key: str, right: DataFrame, id2: str, radius: float, widen: bool = True, apart: bool = False) -> DataFrame:
    """left with the nearest right row's id and distance; ties to the smaller id; `apart`: rows of the same id don't count. The search begins at `radius` and widens until
    each row has its nearest; without `widen`, rows that have none within `radius` get null."""
    fit = F.col(key) != F.col(id2) if apart else F.lit(True)
    best = lambda pairs: pairs.filter(fit).groupBy(key).agg(F.min(F.struct("d", id2)).alias("_b"))
    near, right = left.select(key, "x", "y"), right.select(id2, "x2", "y2")
    found = _widening(near, [key], right, radius, best, F.lit(True)) if widen else best(within(near, right, radius))
    return left.join(found, key, "left").withColumn("distance_m", F.col("_b.d")).withColumn(id2, F.col(f"_b.{id2}")).drop("_b")


def _two_nearest(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of a left box (ax, bx, ay, by) per `keys` and boxes of lines (ax2, bx2, ay2, by2) without the boxes that hold no point of the two lines nearest to
    any place in the left box: they begin further away than all of two lines' boxes end."""
    far = lambda a, b, a2, b2: F.greatest(F.col(b2) - F.col(a), F.col(b) - F.col(a2))
    near = lambda a, b, a2, b2: F.greatest(F.col(a2) - F.col(b), F.col(a) - F.col(b2), F.lit(0.0))
    x, y = ("ax", "bx", "ax2", "bx2"), ("ay", "by", "ay2", "by2")
    size = lambda of: F.sqrt(F.pow(of(*x), 2) + F.pow(of(*y), 2))
    whole = pairs.withColumn("_h", F.min(size(far)).over(Window.partitionBy(*keys, "line_id")))
    second = F.get(F.array_sort(F.collect_set(F.struct("_h", "line_id")).over(Window.partitionBy(*keys))), F.lit(1))["_h"]
    return whole.withColumn("_h", second).filter(size(near) <= F.col("_h") * (1 + 1e-12)).drop("_h")


def _far_lines(nodes: DataFrame, points: DataFrame, size: float, reach: float) -> DataFrame:
    """(row, col, line_id, d): distances of nodes to points, among them the nearest of each node's two nearest lines, however far. Blocks of nodes
    go down a pyramid of tiles of the lines, eight a side in the next larger one, and keep the tiles that may decide; then each node does."""
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    ends = lambda to, x, y, x1, y1: [F.min(x).alias(f"ax{to}"), F.max(x1).alias(f"bx{to}"), F.min(y).alias(f"ay{to}"), F.max(y1).alias(f"by{to}")]
    nodes, points = (written(df.withColumn(tx, at(x)).withColumn(ty, at(y)), "tiled") for df, tx, ty, x, y in ((nodes, "nx", "ny", "x", "y"), (points, "tx", "ty", "x2", "y2")))
    tiles = written(points.groupBy("line_id", "tx", "ty").agg(*ends("2", "x2", "y2", "x2", "y2")), "tiles")
    kept, depth, box = written(nodes.groupBy("nx", "ny").agg(*ends("", "x", "y", "x", "y")), "blocks"), max(0, math.ceil(math.log(max(reach / size, 1.0), 8))), ["ax", "bx", "ay", "by"]
    for k in range(depth, -1, -1):
        level = tiles.groupBy("line_id", F.shiftright("tx", 3 * k).alias("tx"), F.shiftright("ty", 3 * k).alias("ty")).agg(*ends("2", "ax2", "ay2", "bx2", "by2"))
        inner = level.withColumn("px", F.shiftright("tx", 3)).withColumn("py", F.shiftright("ty", 3))
        pairs = kept.crossJoin(F.broadcast(level)) if k == depth else kept.join(inner, ["line_id", "px", "py"])  # the top has at most four tiles a line
        kept = written(_two_nearest(pairs, ["nx", "ny"]).select("nx", "ny", *box, "line_id", F.col("tx").alias("px"), F.col("ty").alias("py"), *[f"{c}2" for c in box]), "kept")
        kept, last = kept.drop(*[f"{c}2" for c in box]), kept
    own = nodes.join(last.drop(*box), ["nx", "ny"]).withColumns({"ax": F.col("x"), "bx": F.col("x"), "ay": F.col("y"), "by": F.col("y")})
    own = _two_nearest(own, ["row", "col"]).select("row", "col", "x", "y", "line_id", F.col("px").alias("tx"), F.col("py").alias("ty"))
    return own.join(points, ["line_id", "tx", "ty"]).withColumn("d", F.sqrt(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2)))


def line_gap(cells: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """(row, col, gap_m): sum of a cell's distances to the two nearest lines, however far; null if there are fewer lines."""

    def two(pairs: DataFrame) -> DataFrame:
        per_line = pairs.groupBy("row", "col", "line_id").agg(F.min("d").alias("d"))
        ranked = per_line.withColumn("_r", F.row_number().over(Window.partitionBy("row", "col").orderBy("d", "line_id"))).filter("_r <= 2")
        return ranked.groupBy("row", "col").agg(F.sum("d").alias("_s"), F.count("*").alias("_n"))

    got = _widening(cells, ["row", "col"], points.select("line_id", "x2", "y2"), radius, two, F.col("_n") == 2, _far_lines)
    return cells.join(got, ["row", "col"], "left").select("row", "col", F.when(F.col("_n") == 2, F.col("_s")).alias("gap_m"))


def inside_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule: an odd number of the ring's edges lies to the right of the point."""
    ends = [*ring[1:], ring[0]]
    hits = None
    for (ax, ay), (bx, by) in zip(ring, ends):
        if ay == by:
            continue
        hit = ((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        hits = hit.cast("int") if hits is None else hits + hit.cast("int")
    return (hits % 2) == 1 if hits is not None else F.lit(False)


def in_polygons(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """(point columns, polygon_id): pairs of points and the polygons that hold them. polygons: (polygon_id, path array<struct<x,y>>); each is
    dealt to the cells its bounds touch, so points meet only the polygons near them."""
    xs, ys = F.transform("path", lambda p: p["x"]), F.transform("path", lambda p: p["y"])
    box = polygons.withColumn("_cx", F.explode(F.sequence(F.floor(F.array_min(xs) / cell), F.floor(F.array_max(xs) / cell)))).withColumn("_cy", F.explode(F.sequence(F.floor(F.array_min(ys) / cell), F.floor(F.array_max(ys) / cell))))
    pairs = _cells(points, cell, "x", "y", False).join(box, ["_cx", "_cy"])
    edges = F.zip_with("path", F.concat(F.slice("path", 2, F.size("path")), F.slice("path", 1, 1)), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    x, y = F.col("x"), F.col("y")
    crossed = F.filter(edges, lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]))
    return pairs.filter(F.size(crossed) % 2 == 1).drop("_cx", "_cy", "path")


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(((px - ax) * dx + (py - ay) * dy) / F.nullif(size, F.lit(0.0)), F.lit(0.0))))
    return F.sqrt(F.pow(px - ax - t * dx, 2) + F.pow(py - ay - t * dy, 2))


def near_segments(points: DataFrame, key: str, segments: DataFrame, buffer: float) -> DataFrame:
    """points with `near`: whether a segment (ax, ay, bx, by) is within `buffer`; segments are dealt to the cells they pass."""
    cell = max(buffer * 4, 1.0)
    s = segments.withColumn("_cx", F.explode(F.sequence(F.floor((F.least("ax", "bx") - buffer) / cell), F.floor((F.greatest("ax", "bx") + buffer) / cell))))
    s = s.withColumn("_cy", F.explode(F.sequence(F.floor((F.least("ay", "by") - buffer) / cell), F.floor((F.greatest("ay", "by") + buffer) / cell))))
    d = segment_distance(*[F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")])
    hit = _cells(points, cell, "x", "y", False).join(s, ["_cx", "_cy"]).filter(d <= buffer).select(key).distinct().withColumn("near", F.lit(True))
    return points.join(hit, key, "left").withColumn("near", F.coalesce("near", F.lit(False)))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) of every node: the smallest id that links (a, b) reach."""
    found = graph.components(links).select(F.col("node").alias("id"), "component")
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def clusters(points: DataFrame, radius: float) -> DataFrame:
    """points (id, x, y) with the component of those linked by steps of at most `radius`."""
    other = points.select(F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    links = within(points.select("id", "x", "y"), other, radius).filter("id < id2").select(F.col("id").cast("long").alias("a"), F.col("id2").cast("long").alias("b"))
    return points.join(components(points.select("id"), links), "id")


def local_maxima(grid: DataFrame, value: str = "value") -> DataFrame:
    """grid cells not smaller than any of their eight neighbours; missing ones don't count. Every cell sends its value to its neighbours."""
    sent = grid.filter(F.col(value).isNotNull()).select(F.explode(F.array(*[F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col"), F.col(value).alias("_v")) for i, j in AROUND if (i, j) != (0, 0)])).alias("c")).select("c.*")
    most = sent.groupBy("row", "col").agg(F.max("_v").alias("_most"))
    return grid.filter(F.col(value).isNotNull()).join(most, ["row", "col"], "left").filter(F.col("_most").isNull() | (F.col(value) >= F.col("_most"))).drop("_most")


def sample_grid(points: DataFrame, grid: DataFrame, x0: float, y0: float, step: float) -> DataFrame:
    """points with the value of the nearest grid node, null beyond half a cell; halves go to the lower node."""
    index = lambda c, o: F.ceil((F.col(c) - o) / step - 0.5).cast("int")
    at = points.withColumn("row", index("y", y0)).withColumn("col", index("x", x0))
    return at.join(grid.select("row", "col", F.col("value").alias("sampled")), ["row", "col"], "left")


def densify(paths: DataFrame, spacing: float) -> DataFrame:
    """(path_id, s, x, y) every `spacing` along each path of rows (path_id, seq, x, y)."""
    w = Window.partitionBy("path_id").orderBy("seq")
    leg = F.coalesce(F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2)), F.lit(0.0))
    legs = paths.withColumn("_d", leg).withColumn("_s", F.sum("_d").over(w))
    legs = legs.select("path_id", "x", "y", F.col("_s").alias("s0"), F.lead("_s").over(w).alias("s1"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"), F.max("_s").over(Window.partitionBy("path_id")).alias("_end"))
    legs = legs.filter("s1 > s0").withColumn("k", F.explode(F.sequence(F.ceil(F.col("s0") / spacing), F.ceil(F.col("s1") / spacing)))).withColumn("s", F.col("k") * spacing)
    inside = (F.col("s") >= F.col("s0")) & ((F.col("s") < F.col("s1")) | ((F.col("s") == F.col("s1")) & (F.col("s1") == F.col("_end"))))
    t = (F.col("s") - F.col("s0")) / (F.col("s1") - F.col("s0"))
    return legs.filter(inside).select("path_id", "s", (F.col("x") + t * (F.col("x1") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("y1") - F.col("y"))).alias("y"))


def convex_hull(points: DataFrame) -> list[tuple[float, float]]:
    """Corners of the points' hull, counter-clockwise; each distinct row of cells sends its two ends only, and the chain is closed on the driver
    over those few."""
    rows = points.groupBy(F.floor("y").alias("_r")).agg(F.min(F.struct("x", "y")).alias("a"), F.max(F.struct("x", "y")).alias("b"), F.min(F.struct("y", "x")).alias("c"), F.max(F.struct("y", "x")).alias("d"))
    pts = sorted({(p[0], p[1]) if i < 2 else (p[1], p[0]) for r in rows.select("a", "b", "c", "d").collect() for i, p in enumerate(r)})
    if len(pts) < 3:
        return pts

    def chain(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(pts) + chain(pts[::-1])


def survey_outline(points: DataFrame, buffer: float, level: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(outline segments (level, ax, ay, bx, by), one row area_m2): edge of what lies within `buffer` of the points, on cells of half that size.

    Only distinct cells are spread, so the work follows the area and not the number of points."""
    from .gridding import contour_segments

    cell = buffer / 2
    taken = points.select(F.floor(F.col("x") / cell).alias("col"), F.floor(F.col("y") / cell).alias("row")).distinct()
    disc = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if i * i + j * j <= 4]
    inside = taken.select(F.explode(F.array(*[F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i, j in disc])).alias("c")).select("c.*").distinct()
    ring = inside.select(F.explode(F.array(*[F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i, j in AROUND])).alias("c")).select("c.*").distinct()
    grid = ring.join(inside.withColumn("value", F.lit(1.0)), ["row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    grid = grid.withColumn("easting", (F.col("col") + 0.5) * cell).withColumn("northing", (F.col("row") + 0.5) * cell)
    return contour_segments(grid, [level]), inside.agg((F.count("*") * cell * cell).alias("area_m2"))


def classify_cells(cells: DataFrame, polygons: DataFrame, value: str, size: float) -> DataFrame:
    """cells (row, col, x, y) with the value of the polygon that holds them; of several the one of largest polygon_id, which was drawn last."""
    held = in_polygons(cells.select("row", "col", "x", "y"), polygons, size)
    best = held.groupBy("row", "col").agg(F.max_by(value, "polygon_id").alias(value))
    return cells.join(best, ["row", "col"], "left")


def keep_inside(grid: DataFrame, rings: list[list[tuple[float, float]]]) -> DataFrame:
    """grid with null outside all rings of (easting, northing); without rings everything stays."""
    if not rings:
        return grid
    inside = F.lit(False)
    for r in rings:
        inside = inside | inside_polygon(F.col("easting"), F.col("northing"), r)
    return grid.withColumn("value", F.when(inside, F.col("value")))


def edge_margin(grid: DataFrame, cell: float, margin_m: float) -> DataFrame:
    """grid (all cells of a rectangle) with in_margin: known cells whose distance to the nearest cell without data, or to the
    rectangle's edge, is at most margin_m. Cells without data are dealt to the cells around them, as far as the margin reaches."""
    reach = int(margin_m // cell)
    known = F.col("value").isNotNull()
    ends = grid.agg(F.min("row").alias("_r0"), F.max("row").alias("_r1"), F.min("col").alias("_c0"), F.max("col").alias("_c1"))
    g = grid.crossJoin(F.broadcast(ends))
    rim = (F.least(F.col("row") - F.col("_r0"), F.col("_r1") - F.col("row"), F.col("col") - F.col("_c0"), F.col("_c1") - F.col("col")) + 1) * cell <= margin_m
    disc = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if (i * i + j * j) ** 0.5 * cell <= margin_m]
    # only empty cells beside a known one matter
    empty = grid.filter(~known).select("row", "col")
    beside = grid.filter(known).select(F.explode(F.array(*[F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i, j in AROUND])).alias("c")).select("c.*").distinct()
    near = empty.join(beside, ["row", "col"]).select(F.explode(F.array(*[F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i, j in disc or [(0, 0)]])).alias("c")).select("c.*").distinct().withColumn("_near", F.lit(True))
    out = g.join(near, ["row", "col"], "left").withColumn("in_margin", known & (rim | F.coalesce("_near", F.lit(False))))
    return out.drop("_near", "_r0", "_r1", "_c0", "_c1")


def mask_margin(marked: DataFrame) -> DataFrame:
    """edge_margin's grid without the cells in the margin, unless that would leave none."""
    left = marked.agg(F.max((F.col("value").isNotNull() & ~F.col("in_margin")).cast("int")).alias("_any"))
    return marked.crossJoin(F.broadcast(left)).withColumn("value", F.when((F.col("_any") == 1) & F.col("in_margin"), None).otherwise(F.col("value"))).drop("_any")


def bilinear(points: DataFrame, grid: DataFrame, x0: float, y0: float, step: float) -> DataFrame:
    """points with `sampled`, between the four nodes around each; null where a node that counts is missing or has no value. Each
    point goes to its own corners, so it is an equi-join."""
    fx, fy = (F.col("x") - x0) / step, (F.col("y") - y0) / step
    c, r = F.floor(fx), F.floor(fy)
    corner = lambda i, j: F.struct((r + i).cast("int").alias("row"), (c + j).cast("int").alias("col"), ((F.lit(1 - i) + (2 * i - 1) * (fy - r)) * (F.lit(1 - j) + (2 * j - 1) * (fx - c))).alias("_w"))
    at = points.select("point_id", F.explode(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)])).alias("k")).select("point_id", "k.*").filter("_w > 0")
    got = at.join(grid.filter(F.col("value").isNotNull()).select("row", "col", "value"), ["row", "col"], "left")
    sums = got.groupBy("point_id").agg(F.sum(F.col("_w") * F.col("value")).alias("_s"), F.max(F.col("value").isNull()).alias("_gap"))
    return points.join(sums, "point_id", "left").withColumn("sampled", F.when(~F.col("_gap"), F.col("_s"))).drop("_s", "_gap")


def near_structures(cells: DataFrame, paths: DataFrame, building_m: float = 15.0, road_m: float = 10.0) -> DataFrame:
    """cells (cell_id, x, y) with `structure`: within the buffer of a path's segments, by its kind. paths: (kind, ax, ay, bx, by), a row
    a segment; kind is building or road."""
    out = cells
    for kind, buffer in (("building", building_m), ("road", road_m)):
        out = near_segments(out, "cell_id", paths.filter(F.col("kind") == kind).select("ax", "ay", "bx", "by"), buffer).withColumnRenamed("near", f"_{kind}")
    return out.withColumn("structure", F.when(F.col("_building"), "building").when(F.col("_road"), "road")).drop("_building", "_road")
