"""Every core query against its SQL twin, and on empty tables."""

import os
import shutil

import duckdb
import pandas as pd
import pyarrow.parquet as pq
import pytest

from gleanery.plans import catalog

DATA = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()
QUERIES = catalog.queries()


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple("null" if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else repr(round(float(v), 9)) if isinstance(v, float) else str(v) for v in row) for row in df.itertuples(index=False))


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for f in os.listdir(DATA):
        pq.write_table(pq.read_table(f"{DATA}/{f}").slice(0, 0), folder / f)
    yield str(folder)
    shutil.rmtree(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() in range(20)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
