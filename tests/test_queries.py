"""Every registered query against its SQL, on the driver's smallest tables."""

from __future__ import annotations

import pytest

from codeloom import plans
from tests.conftest import rows

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, spark, duck, sf):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_point_registers_every_query():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())
