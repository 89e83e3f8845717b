"""The driver's tables as survey tables, in Spark and, word for word, in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "survey": """SELECT *, line_id * 50.0D AS x, CASE WHEN line_id % 2 = 0 THEN s * 5.0D ELSE s * -5.0D END AS y FROM (SELECT event_id AS point_id, {us} / 1e6 AS t, 50000 + value AS mag_raw, CAST(user_id % 4 AS INT) AS source_file_index, CAST(user_id % 40 AS INT) AS line_id, user_id, event_type,
      CAST(row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id) AS INT) AS s FROM events)""",
    "track": """SELECT point_id, source_file_index, n * 0.5D AS t, mag_raw, CAST(floor(n / 120) AS INT) * 40.0D + mag_raw % 1 AS x,
      (CASE WHEN CAST(floor(n / 120) AS INT) % 2 = 0 THEN n % 120 ELSE 119 - n % 120 END) * CASE WHEN CAST(floor(n / 120) AS INT) % 5 = 4 THEN 0.5D ELSE 4.0D END AS y
      FROM (SELECT event_id AS point_id, CAST(user_id % 4 AS INT) AS source_file_index, 50000 + value AS mag_raw, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS n FROM events)""",
    "base": "SELECT {us} / 1e6 AS t, min(value) + 50000 AS mag FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY ts",
    "drone": "SELECT event_id AS point_id, {us} / 1e6 AS t, 50000 + value AS mag_raw FROM events WHERE event_type <> (SELECT min(event_type) FROM events)",
    "geo": "SELECT event_id AS point_id, user_id * 2.4D - 180 AS lon, value / 490.02D * 160 - 80 AS lat, value, props FROM events",
    "grid": """SELECT r AS row, c AS col, r * 10.0D AS northing, c * 10.0D AS easting, avg(v) AS value FROM (SELECT CAST(floor(l_partkey % 256 / 16) AS INT) AS r, CAST(l_partkey % 16 AS INT) AS c, l_quantity + 10 * (l_suppkey % 7) AS v FROM lineitem) GROUP BY r, c""",
    "stations": "SELECT n_name AS iaga_code, n_nationkey * 12.5D - 60 AS lat, n_nationkey * 37.0D % 360 - 180 AS lon FROM nation",
    "observed": "SELECT n_name AS iaga_code, {us} / 1e6 AS t, 40000 + n_nationkey * 100 + value AS mag FROM events JOIN nation ON user_id % 25 = n_nationkey",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "lineitem", "nation") if t in VIEWS[name]}
    return spark.sql(VIEWS[name].format(us="unix_micros(CAST(ts AS TIMESTAMP))").replace("FROM events", "FROM {events}").replace("FROM lineitem", "FROM {lineitem}").replace("JOIN nation", "JOIN {nation}").replace("FROM nation", "FROM {nation}"), **tables)


def ctes(*names: str) -> str:
    import re

    found = [f"{n} AS ({re.sub(r'([0-9.]+)D', r'\1::DOUBLE', VIEWS[n].format(us='epoch_us(ts)'))})" for n in names]
    return "WITH " + ", ".join(found)


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def q6(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0::DOUBLE"
