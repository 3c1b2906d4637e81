"""Every query over the supplied tables against its SQL."""

from __future__ import annotations

import pytest

from customsloom.queries import ORACLES, QUERIES
from tests.conftest import SF


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, same, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert same(got) == same(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[:2] == ["hs_code", "preference"]
