"""Every registered core query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from spanloom.plans.queries import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    import pandas as pd

    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return bool(v)
    if hasattr(v, "year"):
        return str(pd.Timestamp(v).tz_localize(None))
    return v if isinstance(v, str) else round(float(v), 6) + 0.0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.sql(SQL[name]).df()
    assert sorted(want.columns) == columns
    as_rows = lambda df: sorted((tuple(map(plain, r)) for r in df[columns].itertuples(index=False, name=None)), key=repr)
    assert as_rows(got.toPandas()) == as_rows(want)
