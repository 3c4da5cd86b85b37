"""Every query of the entry module that has SQL, against DuckDB at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from lithic import queries, rule_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(rows):
    return sorted((tuple(round(float(v), 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.SQL | rule_queries.SQL))
def test_same_as_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert plain(map(tuple, df.select(*columns).collect())) == plain(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
