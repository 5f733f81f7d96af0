"""Every query against its SQL form on the smallest tables."""

import pytest
from against import SF, agree

import __spark_entry__ as entry
from docquery.plans import queries_files, queries_index

QUERIES = queries_index.QUERIES | queries_files.QUERIES
FORMS = queries_index.SQL | queries_files.SQL


@pytest.mark.parametrize("name", sorted(FORMS))
def test_against_sql(spark, name):
    agree(QUERIES[name](spark, SF), FORMS[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - FORMS.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_contract(spark):
    assert QUERIES.keys() <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert entry.entry(spark).count() > 0
