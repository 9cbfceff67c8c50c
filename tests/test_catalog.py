"""Every query with SQL gives the same rows in DuckDB; the others run."""

import duckdb
import pytest

from tallyway.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    rows = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(rows.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in rows.collect())
    asked = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in asked.description]
    assert sorted(names) == columns
    want = sorted(str(tuple(r[names.index(c)] for c in columns)) for r in asked.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    rows = catalog.QUERIES[name](spark, FOLDER)
    got = rows.collect()
    assert got and all(len(r) == len(rows.columns) for r in got)
