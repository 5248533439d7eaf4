"""Every catalogued query with SQL gives the SQL's rows; no plan has a cross or nested loop join."""

import decimal

import pytest

from tests.conftest import DATA
from tessera.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 9)
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    if name not in SQL:
        assert got
        return
    q = duck.execute(SQL[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, q.fetchall())


def test_flagship_is_a_query():
    assert catalog.FLAGSHIP in QUERIES
