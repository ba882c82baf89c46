"""Every query of the document engine against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from leafwork.plans.registry import ORACLE_SQL, QUERIES

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def rows(frame):
    def plain(x):
        if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return ""
        return f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(plain(x) for x in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    mine = QUERIES[name](spark, str(SF)).toPandas()
    other = duck.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(mine.columns) == sorted(other.columns)
    assert len(mine)
    assert rows(mine) == rows(other)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(SF)).count() > 0
