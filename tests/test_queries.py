"""Every query with SQL against DuckDB on the small tables; every other one must run."""

import os

import duckdb
import pytest

from tidemark import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    a, b = (x[columns].astype(str).replace({"<NA>": "nan", "None": "nan", "NaN": "nan", "NaT": "nan"}) for x in (a, b))
    a, b = (x.sort_values(columns).reset_index(drop=True) for x in (a, b))
    assert a.equals(b)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    rows = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE_SQL:
        con = duckdb.connect()
        for file in os.listdir(SF):
            con.sql(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SF}/{file}'")
        same(rows, con.sql(catalog.ORACLE_SQL[name]).df())
