"""Every query with SQL against DuckDB on the smallest tables, and the entry's promises."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from lexiloom.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def value(x):
        return "null" if x is None or isinstance(x, float) and math.isnan(x) else repr(float(x)) if isinstance(x, float) else str(x)

    return sorted(columns), sorted(tuple(value(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLE_SQL[name])
    want = canonical(cursor.fetchall(), [d[0] for d in cursor.description])
    assert canonical([tuple(r) for r in got.collect()], got.columns) == want
    assert want[1], "an empty result proves nothing"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
