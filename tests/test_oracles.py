"""Every registered query against its SQL, or against a brute-force version where SQL can't express it."""

import brute
import oracle
import pytest

from quillon import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, sf, name):
    run, sql = catalog.queries()[name], catalog.oracle_sql().get(name)
    if sql is None:
        getattr(brute, name)(con, run(spark, sf).collect())
    else:
        assert oracle.difference(run, sql, spark, sf, con) is None


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
