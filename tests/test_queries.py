"""Every core query against its SQL; those without are in test_brute.py."""

import pytest
from oracle import FOLDER, connection, same

from maldadum.plans import registry


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(registry.sql()))
def test_same_rows_as_sql(spark, con, name):
    assert same(spark, con, registry.queries()[name], registry.sql()[name]) == ({}, {})


def test_the_others_are_compared_elsewhere():
    import test_brute

    assert {f"test_{name}" for name in set(registry.queries()) - set(registry.sql())} <= set(dir(test_brute))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
