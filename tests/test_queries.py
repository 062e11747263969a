"""Every registered query against its oracle on the smallest tables."""

import pytest
from harness import SMALL, compare, duck

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# Results that are legitimately empty on the smallest tables.
MAY_BE_EMPTY = {"enr2_document_fields", "jn7_names_with_place", "rk1_mismatch_flags", "sim2_similar_titles"}


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    if name not in ORACLES:
        assert df.count() > 0 or name in MAY_BE_EMPTY
        return
    problem = compare(df, con, ORACLES[name])
    assert problem is None or (problem == "EMPTY" and name in MAY_BE_EMPTY), problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
