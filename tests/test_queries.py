"""Every registered query against its DuckDB text; tables from 0.01 on, as the grid is complete there."""

import os
import sys
from decimal import Decimal

import duckdb
import numpy as np
import pytest

from fluxlode.plans.queries import ORACLES, QUERIES
from fluxlode.plans.tables import view

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
needs_data = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


def plain(rows):
    def one(v):
        if v is None or v != v:
            return ""
        return f"{float(v):.4f}" if isinstance(v, int | float | Decimal) and not isinstance(v, bool) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = duck.execute(ORACLES[name])
    names = [c[0] for c in got.description]
    rows = got.fetchall()
    assert sorted(names) == columns
    want = plain([r[names.index(c)] for c in columns] for r in rows)
    assert plain(map(tuple, df.select(*columns).collect())) == want


@needs_data
def test_minimum_curvature_bends_least_between_known_cells(spark):
    got = QUERIES["i_minimum_curvature"](spark, DIR).toPandas().pivot(index="row", columns="col", values="value").to_numpy()
    known = view(spark, DIR, "grid").toPandas().pivot(index="row", columns="col", values="value").to_numpy()
    r, c = np.indices(known.shape)
    fixed = (r + c) % 3 > 0
    assert np.allclose(got[fixed], known[fixed]) and np.isfinite(got).all()

    def bending(z):
        inner = z[1:-1, 2:] + z[1:-1, :-2] + z[2:, 1:-1] + z[:-2, 1:-1] - 4 * z[1:-1, 1:-1]
        return (inner**2).sum()

    # among the free inner cells no single change of value makes the surface bend less by much
    base = bending(got)
    for i, j in [(4, 5), (7, 8), (9, 9), (6, 9)]:
        assert not fixed[i, j]
        for step in (-0.5, 0.5):
            other = got.copy()
            other[i, j] += step
            assert bending(other) > base
    assert set(QUERIES) - set(ORACLES) == {"i_minimum_curvature"}


@pytest.mark.parametrize("name", ["a_finalize", "c_unproject_utm"])
def test_equals_oracle_on_large_keys(spark, tmp_path, monkeypatch, name):
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    con.execute(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, i * 1543 AS user_id, 'view' AS event_type, CAST(i * 5.61 AS DOUBLE) AS value, '{{}}' AS props FROM range(100) t(i)) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    monkeypatch.setattr(sys.modules[__name__], "DIR", str(tmp_path))
    test_equals_oracle(spark, con, name)
