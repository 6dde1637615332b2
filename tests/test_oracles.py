"""Every core query against its SQL."""

import pytest

from ledgerleaf.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(name, spark, smallest):
    assert QUERIES[name](spark, smallest).columns
    QUERIES[name](spark, smallest).write.format("noop").mode("overwrite").save()
