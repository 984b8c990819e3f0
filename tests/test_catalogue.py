"""Every registered query of the main library against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from seriesloom.plans.catalogue import QUERIES, SQL

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v + 0.0:.9g}"
    return pd.Timestamp(v).isoformat() if hasattr(v, "isoformat") else str(v)


def near(a, b):
    try:
        return math.isclose(float(a), float(b), rel_tol=1e-6, abs_tol=2e-6)
    except ValueError:
        return a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    if name not in SQL:
        assert rows
        return
    out = duck.execute(SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in out.fetchall())
    assert len(rows) == len(want)
    assert all(near(x, y) for r, w in zip(rows, want, strict=True) for x, y in zip(r, w, strict=True)) or rows == want
