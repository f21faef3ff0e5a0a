"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest
from tests.compare import rows_of_duck, rows_of_spark

from foliant.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, sf, duck):
    assert rows_of_spark(QUERIES[name](spark, sf)) == rows_of_duck(duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
