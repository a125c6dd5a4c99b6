"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from conftest import SMALL

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as contract  # noqa: E402
from compare import compare, open_oracle  # noqa: E402

from pixelloom.plans.catalog import QUERIES  # noqa: E402

ORACLE = contract.oracle_sql()
COMPARED = [name for name in contract.queries() if name in ORACLE]


@pytest.fixture(scope="module")
def duck():
    return open_oracle(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(ORACLE) <= set(contract.queries())


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_sql(spark, duck, name):
    assert compare(spark, duck, SMALL, name, contract.queries()[name], ORACLE[name]) is None


def test_entry_is_the_flagship(spark):
    df = contract.entry(spark)
    assert df.columns[:5] == ["image_id", "width", "height", "x", "y"]
    assert df.count() == 200 * 14 * 12
