import glob
import math
import os

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as entry
from lintel.plans import code_queries, table_queries

QUERIES, ORACLES = table_queries.QUERIES | code_queries.QUERIES, table_queries.ORACLES | code_queries.ORACLES


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    def value(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 9)
        return x

    return sorted((tuple(value(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", ORACLES)
def test_same_rows_as_sql(spark, tables, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = plain(tuple(r[n] for n in names) for r in df.collect())
    cursor = tables.execute(ORACLES[name])
    places = {d[0]: i for i, d in enumerate(cursor.description)}
    assert sorted(places) == names
    assert got == plain(tuple(r[places[n]] for n in names) for r in cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
