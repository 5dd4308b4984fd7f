"""Every registered query against its SQL over whole tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
import compare
from checks import queries, sql

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def connection():
    return compare.connect(FOLDER)


def test_every_query_has_sql():
    assert set(queries.queries()) == set(sql.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_same_rows_as_sql(spark, connection, name):
    assert compare.difference(entry.queries()[name](spark, FOLDER), connection, entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
