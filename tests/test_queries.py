"""Every registered query of the reference's operators against its oracle SQL on the smallest tables."""

import oracle
import pytest

from motionspark import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    return oracle.tables(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_the_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    found = duck.execute(catalog.oracle_sql()[name])
    assert not oracle.same([tuple(r) for r in df.collect()], df.columns, found.fetchall(), [c[0] for c in found.description])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
