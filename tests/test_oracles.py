"""Every core query beside its SQL at the smallest scale."""

import importlib

import pytest
from conftest import FOLDER

import __spark_entry__ as E
from compare import difference, rows_of

MODS = [importlib.import_module(f"tarnmill.plans.{m}") for m in E._CORE]
QUERIES = {k: f for m in MODS for k, f in m.queries().items()}
SQL = {k: s for m in MODS for k, s in m.oracle_sql().items()}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    got = rows_of(df)
    assert got
    if name in SQL:
        assert difference(got, df.columns, con, SQL[name]) == ""


def test_contract(spark):
    assert set(E.oracle_sql()) <= set(E.queries())
    assert E.entry(spark).count() > 0
