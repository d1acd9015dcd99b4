"""Each query with SQL against DuckDB."""

import os

import duckdb
import pytest

from quadspark import catalog, catalog_store  # noqa: F401  the second registers its queries with the first


#: The smallest tables repeat one key of lineitem, which is then one node with doubled quads; what
#: multiplies them is held against the next larger tables.
LARGER = {"sparql_aggregates": "/root/testdata/sf0.01"}


@pytest.fixture(scope="module")
def duck():
    def connect(folder):
        con = duckdb.connect()
        con.sql("SET timezone = 'UTC'")
        for name in os.listdir(folder):
            con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{folder}/{name}'")
        return con

    return connect


def norm(v):
    if v is None or v != v:
        return "~"
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.9g}" if isinstance(v, (int, float)) else str(v)


def rows_of(rows, columns, wanted):
    order = [columns.index(c) for c in wanted]
    return sorted(tuple(norm(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, small, duck, name):
    folder = LARGER.get(name, small)
    df = catalog.QUERIES[name](spark, folder)
    result = duck(folder).sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(result.columns)
    wanted = sorted(df.columns)
    assert rows_of([tuple(r) for r in df.collect()], df.columns, wanted) == rows_of(result.fetchall(), result.columns, wanted)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)
