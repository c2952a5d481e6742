"""Every query against its SQL on the smallest tables."""

from pathlib import Path

import pandas as pd
import pytest

from eventloom.plans import queries

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def rows(df: pd.DataFrame) -> list[str]:
    plain = lambda x: None if pd.isna(x) else round(float(x), 6) if isinstance(x, float) else x
    return sorted(str([plain(x) for x in r]) for r in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query(spark, duck, name):
    got, want = queries.QUERIES[name](spark, str(SF)).toPandas(), duck.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) <= set(entry.queries())
