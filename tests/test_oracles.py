"""Every registered query against its SQL on the smallest data; those without SQL must give rows."""

import pytest

import __spark_entry__ as entry_module
from leadspan.checking import compare, connect
from tests.conftest import SF

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
# at the smallest size every document has a vector, so nothing is missing there
MAY_BE_EMPTY = {"missing_embeddings"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        problems = [p for p in compare(df, con, ORACLES[name]) if not (p == "no rows" and name in MAY_BE_EMPTY)]
        assert not problems, problems
    else:
        assert df.limit(1).count() == 1


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
