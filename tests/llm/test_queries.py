"""Every query of the subpackage: equal to its SQL twin where it has one; rows, columns and no product join otherwise."""

import pytest

from spanlake.llm.catalog import load_all
from tests.oracle import compare, connect, product_join

QUERIES = load_all()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    query = QUERIES[name]
    if query.sql is None:
        df = query.run(spark, sf_dir)
        assert not product_join(df)
        assert df.count() > 0
    else:
        assert compare(spark, con, sf_dir, query) is None
