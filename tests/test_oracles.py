"""Every registered query against its SQL on the smallest data set."""

import math

import pytest
from conftest import SMALL

from voxelmill.plans import catalog


def normal(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def table(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(normal(v) for v in row) for row in pdf[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = table(catalog.QUERIES[name](spark, SMALL).toPandas())
    want = table(duck.execute(catalog.ORACLES[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0
