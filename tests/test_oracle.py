"""Every registered query with SQL against DuckDB on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, (list, tuple)) or hasattr(x, "tolist") and getattr(x, "ndim", 0):
        return [plain(y) for y in x]
    if x is None or x is pd.NaT or isinstance(x, float) and x != x:
        return None
    return f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) or hasattr(x, "as_tuple") else str(x)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([plain(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    theirs = rows(columns, cursor.fetchall())
    assert len(ours) == len(theirs) and ours
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    assert not wrong, wrong[:2]


def test_queries_without_sql_run(spark):
    for name in set(__spark_entry__.queries()) - set(SQL):
        if name.startswith("op") or name == "pipeline":
            continue  # tested on their own
        assert __spark_entry__.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns
