"""Every query with SQL against DuckDB, and every query at the smallest scale."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tools.differential import compare, duck

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name, entry.queries()[name], SQL[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_packed_query(spark):
    out = entry.queries()["p4_found"](spark, FOLDER)
    assert out.columns == ["src_field", "row_id", "pos", "val"]
    assert out.where("val is null or trim(val) = '' or pos < 1").count() == 0
    assert out.groupBy("src_field", "row_id").agg({"pos": "max", "val": "count"}).where("`max(pos)` <> `count(val)`").count() == 0
