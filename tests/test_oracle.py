"""Every query against its SQL twin, as DuckDB answers it."""

import duckdb
import pytest

import __spark_entry__ as entry
from wavelark import catalog

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def canon(rows):
    return sorted(repr([float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    rows = [tuple(r) for r in df.select(cols).collect()]
    assert rows
    if name not in catalog.ORACLE_SQL:
        return
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    expected = want.select(", ".join(f'"{c}"' for c in cols)).fetchall()
    assert canon(rows) == canon(expected)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
