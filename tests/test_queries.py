"""Every query with SQL against DuckDB on the smallest tables; the others run."""

import pytest
from conftest import SF, oracle, result

from tidemark.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    got = result(catalogue.QUERIES[name](spark, SF))
    if name in catalogue.ORACLE_SQL:
        want = oracle(catalogue.ORACLE_SQL[name])
        assert got[0] == want[0]
        assert got[1] == want[1]
    else:
        assert got[1]


@pytest.mark.parametrize("name", catalogue.FIXED)
def test_fixed_relation(spark, name):
    query, sql = catalogue.FIXED_RELATIONS[name]
    assert result(query(spark, SF)) == oracle(sql)
