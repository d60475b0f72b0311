"""Queries and their SQL agree on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera import catalog

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def same(frame):
    columns = sorted(frame.columns)
    return sorted((tuple(x.item() if hasattr(x, "item") else x for x in row) for row in frame[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    assert same(catalog.QUERIES[name](spark, FOLDER).toPandas()) == same(con.sql(catalog.ORACLES[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
