"""Every query of the core against its SQL, on the smallest data; the rest at least runs."""

import importlib

import pytest

import __spark_entry__ as entry
import verify

NAMES = [n for m in entry.PLANS for n in importlib.import_module(f"metaloom.plans.{m}").R.queries]


@pytest.fixture(scope="module")
def con(sf):
    return verify.connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    got = verify.rows(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    r = con.execute(sql)
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == verify.rows(cols, r.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["snapshot_no", "asset_id", "change_kind"]


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
