"""Every query of the library with SQL gives what DuckDB gives; the others give rows."""

import pytest
from oracle import connect, expected, rows_of

from mnemospark.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, db, name):
    assert rows_of(QUERIES[name](spark, sf_dir)) == expected(db, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_the_same_rows_twice(spark, sf_dir, name):
    first = rows_of(QUERIES[name](spark, sf_dir))
    assert first == rows_of(QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_reads_the_tables_it_is_given(spark, name):
    """No query answers from rows that are typed in: without tables there is no plan."""
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound"):
        QUERIES[name](spark, "/no/such/folder").collect()
