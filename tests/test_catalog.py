"""Every registered query with SQL gives the SQL's rows."""

import math
import os

import duckdb
import pytest

from dossier.plans import catalog


def rows_of(values):
    return sorted([tuple(round(x, 5) if isinstance(x, float) and not math.isnan(x) else x for x in r) for r in values], key=str)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    want = duck.sql(catalog.oracle_sql()[name])
    at = [want.columns.index(c) for c in df.columns]
    assert rows_of(df.collect()) == rows_of([tuple(r[i] for i in at) for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    rows = df.collect()
    assert rows and all(any(v is not None for v in r) for r in rows) and len({tuple(map(str, r)) for r in rows}) > len(rows) / 2


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
