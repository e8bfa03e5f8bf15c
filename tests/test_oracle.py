"""Every query with SQL gives what DuckDB gives."""

import duckdb
import pytest

from lodestrand.plans import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", list(core.SQL))
def test_same_as_sql(spark, sf_dir, duck, name):
    df = core.QUERIES[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    answer = duck.execute(core.SQL[name])
    columns = [d[0] for d in answer.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows(columns, answer.fetchall())
    assert got


@pytest.mark.parametrize("name", [n for n in core.QUERIES if n not in core.SQL])
def test_runs(spark, sf_dir, name):
    assert core.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
