"""Every registered query against its SQL, on whole tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import duck, duck_result, spark_result

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, connection, name):
    assert spark_result(entry.queries()[name](spark, SF)) == duck_result(connection, entry.oracle_sql()[name])


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_counts_known_in_advance(spark):
    """Distinct documents per scale, counted independently of this package."""
    for folder, distinct in ((SF, 189), ("/root/testdata/sf0.01", 927)):
        assert entry.queries()["dedup_exact"](spark, folder).count() == distinct
