"""Every query that has SQL against DuckDB, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "tinyint": "TINYINT", "smallint": "SMALLINT", "float": "FLOAT"}
ORACLE = entry.oracle_sql()


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    relation = duck.sql(ORACLE[name])
    assert sorted(relation.columns) == columns
    kinds = {c: str(t) for c, t in zip(relation.columns, relation.types, strict=True)}
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == kinds
    rows = Counter(tuple(map(plain, r)) for r in df.select(*columns).collect())
    wanted = Counter(tuple(map(plain, r)) for r in relation.select(*(f'"{c}"' for c in columns)).fetchall())
    assert rows == wanted


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["q_id", "chrom", "strand", "start_pos", "end_pos"]
    assert df.count() > 0


def test_every_query_has_a_plan(spark):
    names = entry.queries()
    assert set(ORACLE) <= set(names)
