"""Every query of this part of the library against its SQL at the smallest scale, and queries without SQL run."""

import glob
import os

import pytest

from keepstone.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no supplied tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    """A value that is equal for equal results: numbers to six places, lists as texts, missing values as None."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, list | tuple):
        return str([plain(v) for v in value])
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, int | float):
        return round(float(value), 6)
    return str(value)


def rows(columns, table):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in table), key=str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    got = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    told = duck.execute(sql)
    columns = [c[0] for c in told.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, told.fetchall())


def test_oracles_belong_to_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())
