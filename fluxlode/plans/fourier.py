"""The Fourier filters of a complete grid of 16 x 16 cells as DuckDB's SQL: padded, ramped, and transformed by sums of sines and cosines."""

from __future__ import annotations

from math import cos, radians, sin

from .tables import ctes, q6

N, PAD, CELL = 16, 4, 10.0
WIDE = N + 2 * PAD
TURN = f"2 * pi() / {WIDE}"
PREPARE = f""", m AS (SELECT avg(value) AS mean FROM grid),
ix AS MATERIALIZED (SELECT i, CASE WHEN i < {PAD} THEN {PAD} - i WHEN i < {PAD + N} THEN i - {PAD} ELSE {2 * N + PAD - 2} - i END AS src,
  CASE WHEN i < {PAD} THEN 0.5 * (1 - cos(pi() * (i + 0.5) / {PAD})) WHEN i >= {PAD + N} THEN 0.5 * (1 - cos(pi() * ({WIDE} - i - 0.5) / {PAD})) ELSE 1 END AS ramp,
  2 * pi() * (CASE WHEN i < {WIDE // 2} THEN i ELSE i - {WIDE} END) / {WIDE * CELL} AS wave FROM (SELECT unnest(range({WIDE})) AS i)),
z AS (SELECT a.i AS r, b.i AS c, (value - mean) * a.ramp * b.ramp AS v FROM grid JOIN ix a ON row = a.src JOIN ix b ON col = b.src, m),
f1 AS MATERIALIZED (SELECT r, k.i AS kc, sum(v * cos({TURN} * c * k.i)) AS re, -sum(v * sin({TURN} * c * k.i)) AS im FROM z, ix k GROUP BY 1, 2),
f2 AS MATERIALIZED (SELECT k.i AS kr, kc, k.wave AS n, q.wave AS e, sqrt(k.wave * k.wave + q.wave * q.wave) AS k, sum(re * cos({TURN} * r * k.i) + im * sin({TURN} * r * k.i)) AS re,
  sum(im * cos({TURN} * r * k.i) - re * sin({TURN} * r * k.i)) AS im FROM f1, ix k, ix q WHERE q.i = kc GROUP BY ALL)"""


def channel(name: str, real: str, imaginary: str, constant: float = 0.0) -> str:
    """CTE {name} (row, col, v): the grid filtered by a response of n, e and k; constant: its value at k = 0."""
    return f""", {name}h AS (SELECT kr, kc, re, im, CASE WHEN k = 0 THEN {constant} ELSE {real} END AS hr, CASE WHEN k = 0 THEN 0 ELSE {imaginary} END AS hi FROM f2),
{name}1 AS MATERIALIZED (SELECT r.i AS r, kc, sum((re * hr - im * hi) * cos({TURN} * r.i * kr) - (re * hi + im * hr) * sin({TURN} * r.i * kr)) AS re,
  sum((re * hr - im * hi) * sin({TURN} * r.i * kr) + (re * hi + im * hr) * cos({TURN} * r.i * kr)) AS im FROM {name}h, ix r WHERE r.i BETWEEN {PAD} AND {PAD + N - 1} GROUP BY 1, 2),
{name} AS MATERIALIZED (SELECT r - {PAD} AS row, c.i - {PAD} AS col, sum(re * cos({TURN} * c.i * kc) - im * sin({TURN} * c.i * kc)) / {WIDE * WIDE} + any_value(mean) * {constant} AS v
  FROM {name}1, ix c, m WHERE c.i BETWEEN {PAD} AND {PAD + N - 1} GROUP BY 1, 2)"""


def _field(inclination: float, declination: float) -> tuple[str, str, str]:
    """Real and imaginary part of the field's direction, and that of its horizontal part for a flat field."""
    north, east = f"(n * {cos(radians(declination))!r}::DOUBLE)", f"(e * {sin(radians(declination))!r}::DOUBLE)"
    return f"(k * {sin(radians(inclination))!r}::DOUBLE)", f"({cos(radians(inclination))!r}::DOUBLE * ({north} + {east}))", f"({north} + {east})"


def _pole(inclination: float = 55.0, declination: float = -8.0, cap: float = 20.0) -> str:
    a, b, _ = _field(inclination, declination)
    size = f"(k * k / ({a} * {a} + {b} * {b}))"
    share = f"least(1.0, {cap} / {size}) * k * k / pow({a} * {a} + {b} * {b}, 2)"
    return channel("x", f"{share} * ({a} * {a} - {b} * {b})", f"-{share} * 2 * {a} * {b}", 1.0)


def _equator(inclination: float = 55.0, declination: float = -8.0) -> str:
    a, b, flat = _field(inclination, declination)
    share = f"-({flat} * {flat}) / pow({a} * {a} + {b} * {b}, 2)"
    return channel("x", f"{share} * ({a} * {a} - {b} * {b})", f"-({share}) * 2 * {a} * {b}", 1.0)


def _microlevel(strength: float = 0.8, tolerance: float = 15.0, spacing: float = 20.0, factor: float = 4.0) -> str:
    """Lines of azimuth 0: what varies with e lies across them."""
    fan = f"exp(-0.5 * pow(degrees(acos(least(abs(e) / k, 1.0))) / {tolerance}, 2))"
    return channel("x", f"1 - {strength} * {fan} / (1 + pow(2 * pi() / {factor * spacing} / k, 8))", "0", 1.0)


EAST, NORTH, DOWN = channel("x", "0", "e"), channel("y", "0", "n"), channel("d", "k", "0")
THREE = EAST + NORTH + DOWN
FLAT = "sqrt(x.v * x.v + y.v * y.v)"
TRANSFORMS: dict[str, tuple[str, str]] = {
    "rtp": (_pole(), "x.v"), "rte": (_equator(), "x.v"), "upward": (channel("x", "exp(-20 * k)", "0", 1.0), "x.v"), "microlevel": (_microlevel(), "x.v"),
    "1vd": (channel("x", "k", "0"), "x.v"), "2vd": (channel("x", "k * k", "0"), "x.v"), "dx": (EAST, "x.v"), "dy": (channel("x", "0", "n"), "x.v"),
    "dxx": (channel("x", "-e * e", "0"), "x.v"), "dyy": (channel("x", "-n * n", "0"), "x.v"), "dxy": (channel("x", "-n * e", "0"), "x.v"),
    "dxz": (channel("x", "0", "e * k"), "x.v"), "dyz": (channel("x", "0", "n * k"), "x.v"),
    "as": (THREE, "sqrt(x.v * x.v + y.v * y.v + d.v * d.v)"), "thdr": (THREE, FLAT), "tilt": (THREE, f"degrees(atan2(d.v, {FLAT}))"),
    "theta": (THREE, f"degrees(acos(least({FLAT} / sqrt(x.v * x.v + y.v * y.v + d.v * d.v), 1.0)))"),
}


def transform_sql(name: str) -> str:
    made, value = TRANSFORMS[name]
    three = " JOIN y USING (row, col) JOIN d USING (row, col)" if "y AS" in made and "d AS" in made else ""
    return ctes("grid") + PREPARE + made + f" SELECT grid_id, row, col, northing, easting, {q6(value)} AS value FROM grid JOIN x USING (row, col){three}, (SELECT CAST(unnest(range(2)) AS INT) AS grid_id)"
