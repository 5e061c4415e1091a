"""Every registered query against its SQL on the smallest tables, or against plain Python where SQL can't express it."""

import math

import pytest

from paperloom.plans import registry
from tests.brute import BRUTE
from tests.conftest import SMALL


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, duck):
    df = registry.queries()[name](spark, SMALL)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        BRUTE[name]([r.asDict() for r in df.collect()], spark)
        return
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    relation = duck.sql(sql)
    assert sorted(relation.columns) == columns
    places = [relation.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[k]) for k in places) for r in relation.fetchall()), key=repr)
    assert got == want


def test_each_query_is_checked():
    assert BRUTE.keys() == registry.queries().keys() - registry.oracle_sql().keys()
