"""Every query with SQL gives the SQL's rows; the others give rows."""

import pytest
from plain_rows import DATA, rows

from quillworks.plans.oracles import oracle_sql
from quillworks.plans.queries import QUERIES

SQL = oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).limit(5).count()
