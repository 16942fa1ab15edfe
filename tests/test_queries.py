import duckdb
import pandas as pd
import pytest

from rippleframe.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def _rows(frame):
    """Sorted rows; each value with whether it is null."""
    return sorted(tuple((bool(pd.isna(v)), 0 if pd.isna(v) else v) for v in row) for row in frame.values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "documents", "lineitem", "part", "labels", "events", "conversations", "orders", "customer", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name]).df()
    columns = sorted(want.columns)
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == columns
    assert _rows(got[columns]) == _rows(want[columns])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
