"""Every registered query against its SQL."""

import pytest
from oracle import connect, differences

from glossator.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    if name in registry.ORACLE_SQL:
        assert differences(df, registry.ORACLE_SQL[name], duck) is None
    else:
        assert df.count() > 0


def test_errors_are_small(spark, sf):
    assert registry.vec_int8_scan_error(spark, sf).first().error < 0.01
    assert registry.f16_roundtrip(spark, sf).first().error < 5e-4
