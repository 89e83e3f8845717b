"""Registry of the survey operators' queries over the driver's tables."""

from __future__ import annotations

from . import edits, files, points, surfaces  # noqa: F401  the others register their queries with those of points

QUERIES = dict(points.QUERIES)
ORACLES = dict(points.ORACLES)
FLAGSHIP = "f_tmi_by_line"
