import comparing
import pytest

from gavelspark.plans import core_queries, reference_queries

QUERIES = {**core_queries.queries(), **reference_queries.queries()}
SQL = {**core_queries.oracle_sql(), **reference_queries.oracle_sql()}


@pytest.fixture(scope="module")
def con():
    return comparing.connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    names, rows = comparing.rows_of(QUERIES[name](spark, comparing.DATA))
    expected_names, expected = comparing.sql_rows(con, SQL[name])
    assert names == expected_names
    assert rows == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, comparing.DATA)
    assert df.columns and df.count() >= 0


def test_entry_module_lists_all_queries(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["table_name", "month", "kind", "n_rows", "n_refs"]
