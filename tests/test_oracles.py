"""Every registered query with SQL gives the same rows as the SQL."""

import pytest

from runeworks.plans.oracles import oracle_sql
from runeworks.plans.queries import queries
from tests.conftest import DATA, normal


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, duck, name):
    mine = queries()[name](spark, DATA).toPandas()
    theirs = duck.execute(oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert normal(mine) == normal(theirs)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql()) - {"search_beam", "annotate_top1", "rescued_puzzles"}))
def test_runs(spark, name):
    rows = queries()[name](spark, DATA)
    assert rows.count() > 0 and len(set(rows.columns)) == len(rows.columns)
