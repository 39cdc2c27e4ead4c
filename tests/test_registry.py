"""Every registered query with SQL gives the rows that DuckDB gives; the others give rows."""

import os

import duckdb
import pandas as pd
import pytest

from tidegate.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or (not isinstance(value, (list, tuple)) and not hasattr(value, "shape") and pd.isna(value)):
        return "~"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, (int, float)) or hasattr(value, "dtype"):
        return round(float(value), 5)
    return str(value)


def rows_of(frame):
    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    text = registry.oracle_sql().get(name)
    if text is None:
        assert len(got) > 0
        return
    wanted = duck.execute(text).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows_of(got) == rows_of(wanted)
