"""Every registered query against its DuckDB oracle (``PARITY_SF``, default 0.001)."""

import os

import pytest

from oracle.sql import SQL
from shopflow.plans.registry import QUERIES
from tests.parity import compare, duck

SF = os.environ.get("PARITY_SF", "0.001")
FOLDER = f"/root/testdata/sf{SF}"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_parity(spark, con, name):
    r = compare(spark, name, FOLDER, con)
    assert r.get("ok"), r.get("error")


def test_entry_runs(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.columns == ["dt", "sessions", "orders", "conversion_rate"]
    assert df.count() > 0
