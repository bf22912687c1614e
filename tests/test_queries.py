import pytest

from wireloom.jobs.registry import ORACLE_SQL, QUERIES

from .conftest import SMALL, same_rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    named, got, want = same_rows(df, duck, ORACLE_SQL[name])
    assert named
    assert got == want


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
