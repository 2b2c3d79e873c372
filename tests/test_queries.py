"""Every query of the library against its SQL, on the smallest tables."""

import pytest
from conftest import SMALL, rows_of

from lodeweave.plans import run_queries  # noqa: F401
from lodeweave.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert len(got.columns)
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(got.columns)
        assert rows_of(got, columns) == rows_of(want, columns)
