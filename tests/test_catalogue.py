import pytest

from corpusmill.plans import catalogue
from tests.oracle import connect, same

DIR = "/root/testdata/sf0.001"
Q, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, name):
    same(Q[name](spark, DIR), connect(DIR), SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_rows(spark, name):
    assert Q[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
