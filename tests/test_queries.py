"""Every registered query against its SQL, on the smallest tables; those without SQL must run and give rows."""

import pytest
from compare import DATA, connect, differences

from tidemill import plans

QUERIES, SQL = plans.registry()


@pytest.fixture(scope="module")
def db():
    return connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in SQL:
        assert differences(got, db.sql(SQL[name]).df()) == []
    else:
        assert len(got) > 0


def test_entry_names_are_consistent():
    assert set(SQL) <= set(QUERIES)
    assert plans.FLAGSHIP in QUERIES
