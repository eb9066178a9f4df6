import pytest

from ledgerspark.plans import queries, queries_questions, queries_rows, queries_selection  # noqa: F401

from .compare import differences, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, sf, con, name):
    assert differences(spark, con, sf, queries.RUN[name], queries.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries.RUN) - set(queries.SQL)))
def test_query_runs(spark, sf, name):
    assert queries.RUN[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() > 0
