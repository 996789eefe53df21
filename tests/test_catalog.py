"""Registered queries against independent SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry
from verification.compare import duck, rows_of

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = con.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


# Fits of all starts until they converge: minutes even on the smallest data. tests/test_model.py and the
# given_model queries test their parts; README gives measured times.
WHOLE_FITS = {
    "hsmm_fits", "hsmm_model_selection", "hsmm_final_summary", "hsmm_parameters", "viterbi_decode",
    "hsmm_pairwise_stability", "hsmm_state_similarity",
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - WHOLE_FITS))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert not QUERIES[name](spark, sf_dir).isEmpty()


def test_entry(spark):
    assert entry.entry(spark).count() == 5
