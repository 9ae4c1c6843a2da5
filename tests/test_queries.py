"""Every query of the core with SQL gives what DuckDB gives; the others give rows."""

import oracle
import pytest

from corpusmill.plans.queries import ORACLES, QUERIES

MAY_BE_EMPTY = {"pf12_drop_named", "j5_leakage"}


@pytest.fixture(scope="module")
def con(small):
    return oracle.duck(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, small, con, name):
    if name == "t4_prefix_sample" or name == "j3_split_off":
        n = con.execute("SELECT count(DISTINCT problem_id) FROM manifest WHERE starts_with(problem_id, 'Tidecoder/')").fetchall()[0][0]
        if n < 25:
            pytest.skip("too few candidates at this size")
    assert oracle.compare(spark, con, QUERIES[name], ORACLES[name], small) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
