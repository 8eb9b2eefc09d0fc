"""Every registered query against its SQL twin."""

import sys

import pytest

from tests.conftest import ROOT, SF

sys.path.insert(0, str(ROOT / "scripts"))

from check import compare, database  # noqa: E402

from docloom.plans.catalog import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_twin(spark, db, name):
    ok, message = compare(spark, db, QUERIES[name], SF)
    assert ok, message


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
