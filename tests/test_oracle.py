"""Every catalogue query against its SQL on the smallest sample tables."""

import pytest
from compare import compare

from plumbline import catalog

catalog.load_all()


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, folder, name):
    ok, message = compare(spark, folder, name, catalog.QUERIES[name], catalog.SQL.get(name))
    assert ok, message


def test_every_sql_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
