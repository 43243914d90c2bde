import pytest
from conftest import against_sql

import __spark_entry__ as entry
from voxloom.plans import catalogue


@pytest.mark.parametrize("name", list(catalogue.ORACLE))
def test_equals_sql(spark, sf_dir, name):
    got, want = against_sql(spark, sf_dir, catalogue.QUERIES[name], catalogue.ORACLE[name])
    assert got == want


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE)


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
