"""Every registered query against its SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

from paperglass.plans.catalogue import ORACLE_SQL, QUERIES
from tests.conftest import rows_of

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_same_again(spark, name):
    assert rows_of(QUERIES[name](spark, SF).toPandas()) == rows_of(QUERIES[name](spark, SF).toPandas())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["id", "paper_id", "number_path", "marks", "year"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
