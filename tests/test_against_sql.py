"""Every registered query with SQL gives the same rows as that SQL."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, name):
    lines = []
    query = {name: entry.queries()[name]}
    bad = compare(spark, FOLDER, query, lines.append)
    assert not bad, lines


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 8
