"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from shutterlake.plans.catalog import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    own = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        own.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return own


def rows(frame):
    frame = frame[sorted(frame)]
    plain = lambda v: "" if v is None or v is pd.NA or v is pd.NaT or v != v else v if isinstance(v, str) else round(float(v), 6)
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got) == sorted(want)
        assert rows(got) == rows(want)
