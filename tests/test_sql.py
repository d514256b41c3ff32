"""Every registered query against its SQL on the smallest tables."""

import pytest

from checks import registry
from checks.compare import compare

WANTED = list(registry.QUERIES)


@pytest.mark.parametrize("name", WANTED)
def test_query(spark, sf_dir, name):
    if name not in registry.ORACLE:
        assert registry.QUERIES[name](spark, sf_dir).count() >= 0
    else:
        assert compare(spark, sf_dir, name, registry.QUERIES[name], registry.ORACLE[name]) == ""


def test_every_sql_has_a_query():
    assert set(registry.ORACLE) <= set(registry.QUERIES)
    assert set(registry.QUERIES) == set(registry.ORACLE)
