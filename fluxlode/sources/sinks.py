"""Exports: tables as CSV or Parquet written in parallel, grids and outlines in small public binary and text formats."""

from __future__ import annotations

import struct
import zipfile
from io import BytesIO

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GRD_EMPTY = 1.70141e38
WGS84 = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
POINT_COLUMNS = ["point_id", "timestamp", "lat", "lon", "mag_raw", "mag_filtered", "anomaly", "tmi", "line_id"]


def csv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """(value): the columns of each row as one line of CSV; nulls are empty."""
    cell = lambda c: F.coalesce(F.when(F.col(c).cast("string").rlike('[",\\n]'), F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c).cast("string")), F.lit(""))
    return df.select(F.concat_ws(",", *map(cell, columns)).alias("value"))


def points_csv(points: DataFrame, path: str) -> None:
    """The points' main columns and `excluded`, as a folder of CSV files with headers."""
    have = [c for c in POINT_COLUMNS if c in points.columns]
    points.select(*have, (F.col("line_id") < 0).alias("excluded")).write.mode("overwrite").option("header", True).csv(path)


def ranked_targets(targets: DataFrame) -> DataFrame:
    """Targets with target_id, their rank by quality from 1. They are few: one window orders them."""
    ranked = targets.withColumn("target_id", F.row_number().over(Window.orderBy(F.desc("quality"), "x", "y")))
    return ranked.select("target_id", *targets.columns)


def targets_csv(targets: DataFrame, path: str) -> None:
    ranked_targets(targets).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def base_csv(base: DataFrame, path: str) -> None:
    base.select("timestamp", F.col("mag").alias("mag_nT")).write.mode("overwrite").option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)


def grid_xyz(grid: DataFrame, lat, lon) -> DataFrame:
    """(value): a text line `lon lat value` for each known cell, to be written in row-major order."""
    known = grid.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return known.orderBy("row", "col").select(F.format_string("%.7f %.7f %.4f", lon, lat, F.col("value")).alias("value"))


def model_csv(model: DataFrame, path: str) -> None:
    model.filter("active").select("x", "y", "z", "chi").write.mode("overwrite").option("header", True).csv(path)


def save_project(tables: dict[str, DataFrame], path: str, settings: dict | None = None) -> None:
    """Every table of a project as Parquet below `path`, and its settings as a one-row table."""
    import json

    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(settings or {}, sort_keys=True), json.dumps(sorted(tables)))], "settings string, tables string").write.mode("overwrite").parquet(f"{path}/project")


def load_project(spark, path: str) -> tuple[dict[str, DataFrame], dict]:
    import json

    row = spark.read.parquet(f"{path}/project").first()
    return {n: spark.read.parquet(f"{path}/{n}") for n in json.loads(row.tables)}, json.loads(row.settings)


def surfer_grd(values: np.ndarray, x0: float, y0: float, cell: float) -> bytes:
    """Surfer 6 binary grid; rows go north; NaN is empty."""
    ny, nx = values.shape
    if max(nx, ny) > 32767:
        raise ValueError("a side has more than 32767 nodes")
    known = values[np.isfinite(values)]
    low, high = (known.min(), known.max()) if len(known) else (0.0, 0.0)
    head = b"DSBB" + struct.pack("<hh6d", nx, ny, x0, x0 + cell * (nx - 1), y0, y0 + cell * (ny - 1), low, high)
    return head + np.where(np.isfinite(values), values, GRD_EMPTY).astype("<f4").tobytes()


def geotiff(values: np.ndarray, x0: float, y0: float, cell: float, epsg: int) -> bytes:
    """Single-band float32 GeoTIFF, north up; nodes are pixel centres; NaN is no data."""
    ny, nx = values.shape
    data = values[::-1].astype("<f4").tobytes()
    keys = struct.pack("<16H", 1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg)
    scale, tie, empty = struct.pack("<3d", cell, cell, 0), struct.pack("<6d", 0, 0, 0, x0 - cell / 2, y0 + cell * (ny - 0.5), 0), b"nan\0"
    extra = 8
    blobs = {}
    for name, blob in (("scale", scale), ("tie", tie), ("keys", keys), ("data", data)):
        blobs[name] = extra
        extra += len(blob)
    tags = [(256, 4, 1, nx), (257, 4, 1, ny), (258, 3, 1, 32), (259, 3, 1, 1), (262, 3, 1, 1), (273, 4, 1, blobs["data"]), (277, 3, 1, 1), (278, 4, 1, ny), (279, 4, 1, len(data)), (339, 3, 1, 3), (33550, 12, 3, blobs["scale"]), (33922, 12, 6, blobs["tie"]), (34735, 3, 16, blobs["keys"]), (42113, 2, 4, int.from_bytes(empty, "little"))]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
    return struct.pack("<2sHI", b"II", 42, extra) + scale + tie + keys + data + ifd


def bln(ring: list[tuple[float, float]]) -> bytes:
    closed = [*ring, ring[0]] if ring[0] != ring[-1] else ring
    return "\n".join([f"{len(closed)},1", *[f"{x:.3f},{y:.3f}" for x, y in closed]]).encode() + b"\n"


def kml(rings: list[list[tuple[float, float]]], name: str = "boundary") -> str:
    """Rings of (lat, lon) as a KML polygon, or several in one geometry."""
    polygons = ["<Polygon><outerBoundaryIs><LinearRing><coordinates>" + " ".join(f"{lon:.8f},{lat:.8f},0" for lat, lon in [*r, r[0]]) + "</coordinates></LinearRing></outerBoundaryIs></Polygon>" for r in rings]
    body = polygons[0] if len(polygons) == 1 else "<MultiGeometry>" + "".join(polygons) + "</MultiGeometry>"
    safe = name.replace("&", "&amp;").replace("<", "&lt;")
    return f'<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><name>{safe}</name>{body}</Placemark></Document></kml>'


def _shp_header(kind: int, words: int, box) -> bytes:
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, kind, *box, 0, 0, 0, 0)


def shapefile(kind: str, shapes: list, fields: dict[str, list], name: str = "layer") -> bytes:
    """ZIP of a shapefile in WGS84: kind `point` with (lon, lat) or `polygon` with lists of rings of (lon, lat); fields are numbers or text."""
    code = {"point": 1, "polygon": 5}[kind]
    records, index, at = b"", b"", 50
    flat = [p for s in shapes for p in ([s] if code == 1 else [q for r in s for q in r])]
    box = (min(p[0] for p in flat), min(p[1] for p in flat), max(p[0] for p in flat), max(p[1] for p in flat)) if flat else (0, 0, 0, 0)
    for n, s in enumerate(shapes, 1):
        if code == 1:
            body = struct.pack("<i2d", 1, *s)
        else:
            rings = [[*r, r[0]] if r[0] != r[-1] else r for r in s]
            pts = [p for r in rings for p in r]
            starts = np.r_[0, np.cumsum([len(r) for r in rings])[:-1]].astype("<i4")
            body = struct.pack("<i4d2i", 5, min(p[0] for p in pts), min(p[1] for p in pts), max(p[0] for p in pts), max(p[1] for p in pts), len(rings), len(pts)) + starts.tobytes() + np.array(pts, "<f8").tobytes()
        index += struct.pack(">2i", at, len(body) // 2)
        records += struct.pack(">2i", n, len(body) // 2) + body
        at += 4 + len(body) // 2
    widths = {f: ("N", 19, 6) if all(isinstance(v, int | float) or v is None for v in vs) else ("C", 64, 0) for f, vs in fields.items()}
    size = 1 + sum(w for _, w, _ in widths.values())
    dbf = struct.pack("<4BIHH20x", 3, 124, 1, 1, len(shapes), 33 + 32 * len(widths), size)
    dbf += b"".join(f[:10].encode().ljust(11, b"\0") + t.encode() + b"\0\0\0\0" + bytes([w, d]) + b"\0" * 14 for f, (t, w, d) in widths.items()) + b"\r"
    for row in zip(*fields.values()) if fields else []:
        dbf += b" " + b"".join((f"{v:.6f}".rjust(w)[:w] if t == "N" and v is not None else "".rjust(w) if v is None else str(v)[:w].ljust(w)).encode("ascii", "replace") for v, (t, w, _) in zip(row, widths.values()))
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(f"{name}.shp", _shp_header(code, 50 + len(records) // 2, box) + records)
        z.writestr(f"{name}.shx", _shp_header(code, 50 + len(index) // 2, box) + index)
        z.writestr(f"{name}.dbf", dbf + b"\x1a")
        z.writestr(f"{name}.prj", WGS84)
    return out.getvalue()


def report_markdown(sections: dict[str, dict]) -> str:
    """A report of titled sections of figures; a section without any says so."""
    out = ["# Survey report"]
    for title, figures in sections.items():
        out.append(f"\n## {title}\n")
        out += [f"- {k}: {v:.3f}" if isinstance(v, float) else f"- {k}: {v}" for k, v in figures.items()] or ["- not evaluated"]
    return "\n".join(out) + "\n"


def coloured(values: np.ndarray, anchors: list[tuple[int, int, int]], low: float | None = None, high: float | None = None, shade: bool = False, azimuth: float = 315.0, altitude: float = 45.0, cell: float = 1.0, exaggeration: float = 3.0) -> np.ndarray:
    """(ny, nx, 4) bytes of a grid on a bar of evenly spaced anchor colours, clear where there is no data; shaded by its slopes if wanted."""
    known = np.isfinite(values)
    low = float(np.nanmin(values)) if low is None and known.any() else (low or 0.0)
    high = float(np.nanmax(values)) if high is None and known.any() else (high or 1.0)
    at = np.clip((np.where(known, values, low) - low) / ((high - low) or 1.0), 0, 1)
    places = np.linspace(0, 1, len(anchors))
    rgb = np.stack([np.interp(at, places, [a[c] for a in anchors]) for c in range(3)], -1)
    if shade:
        north, east = np.gradient(np.where(known, values, np.nanmean(values) if known.any() else 0.0) * exaggeration, cell)
        slope, facing = np.arctan(np.hypot(north, east)), np.arctan2(-east, -north)
        light = np.sin(np.radians(altitude)) * np.cos(slope) + np.cos(np.radians(altitude)) * np.sin(slope) * np.cos(np.radians(azimuth) - facing)
        rgb = rgb * (0.4 + 0.6 * np.clip(light, 0, 1))[..., None]
    return np.dstack([np.round(rgb), np.where(known, 255, 0)]).astype(np.uint8)


def png(rgba: np.ndarray) -> bytes:
    """An image, first row at the bottom as in a grid."""
    import zlib

    ny, nx, _ = rgba.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.hstack([np.zeros((ny, 1), np.uint8), rgba[::-1].reshape(ny, nx * 4)]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", nx, ny, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def geotiff_coloured(rgba: np.ndarray, x0: float, y0: float, cell: float, epsg: int) -> bytes:
    """Four-band byte GeoTIFF of `coloured`, north up; nodes are pixel centres; the fourth band is opacity."""
    ny, nx, _ = rgba.shape
    blobs, at, body = {}, 8, b""
    keys = struct.pack("<16H", 1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg)
    tie = struct.pack("<6d", 0, 0, 0, x0 - cell / 2, y0 + cell * (ny - 0.5), 0)
    for name, blob in (("bits", struct.pack("<4H", 8, 8, 8, 8)), ("scale", struct.pack("<3d", cell, cell, 0)), ("tie", tie), ("keys", keys), ("data", rgba[::-1].tobytes())):
        blobs[name], at, body = at, at + len(blob), body + blob
    tags = [(256, 4, 1, nx), (257, 4, 1, ny), (258, 3, 4, blobs["bits"]), (259, 3, 1, 1), (262, 3, 1, 2), (273, 4, 1, blobs["data"]), (277, 3, 1, 4), (278, 4, 1, ny), (279, 4, 1, nx * ny * 4), (284, 3, 1, 1), (338, 3, 1, 2), (33550, 12, 3, blobs["scale"]), (33922, 12, 6, blobs["tie"]), (34735, 3, 16, blobs["keys"])]
    return struct.pack("<2sHI", b"II", 42, at) + body + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
