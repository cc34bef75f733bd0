"""Contract: every query runs; those with a SQL twin give the same rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ("work_year_balance", "mark_toggle", "text_normalize", "catalog_build", "publish_select",
          "knn_file", "quota_ledger", "incidents", "related_items")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 80


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
