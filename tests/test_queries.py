"""Every registered query beside its SQL, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest
from check_queries import compare, duck

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.filterwarnings("ignore::UserWarning")
@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    assert compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), FOLDER) is None


def test_entry(spark):
    assert not entry.entry(spark).isEmpty()


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
