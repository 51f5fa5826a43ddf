"""Every query against its SQL in DuckDB, at the smallest scale; queries without SQL by what must hold."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from thalweg import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    value = lambda x: None if pd.isna(x) else bool(x) if isinstance(x, bool) or type(x).__name__ == "bool_" else float(x) if isinstance(x, (int, float)) or hasattr(x, "dtype") else x
    return sorted((tuple(map(value, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want) or name == "unseen_components"
    a, b = rows(got), rows(want)
    assert a == b, (len(a), len(b), [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
