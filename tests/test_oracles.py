"""Every query with oracle SQL against DuckDB on the driver's tables."""

import math
from pathlib import Path

import duckdb
import pytest

from oscilla.plans import queries

DATA = Path("/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, db, name):
    got = queries.QUERIES[name](spark, str(DATA))
    cur = db.execute(queries.ORACLES[name])
    cols = sorted(c[0] for c in cur.description)
    assert sorted(got.columns) == cols
    place = {c[0]: i for i, c in enumerate(cur.description)}
    want = sorted(([cell(row[place[c]]) for c in cols] for row in cur.fetchall()), key=str)
    rows = sorted(([cell(row[c]) for c in cols] for row in got.collect()), key=str)
    assert rows == want
