"""Registered corpus queries against their SQL."""

import pytest
from oracle import connect, differences

from glossator.llm import queries


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_sql(spark, sf, name):
    assert differences(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], connect(sf)) is None
