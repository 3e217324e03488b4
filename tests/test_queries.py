"""Every registered query with SQL, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from gaugeworks.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry()))
def test_query(name, spark, con):
    q = registry()[name]
    got = q.run(spark, SF).toPandas()
    assert len(got) > 0
    if q.sql:
        want = con.sql(q.sql).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        order = lambda x: x[cols].astype(str).sort_values(cols).reset_index(drop=True)
        assert order(got).equals(order(want))
