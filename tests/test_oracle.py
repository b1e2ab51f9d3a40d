"""Every registered query against its DuckDB SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle_harness import compare, duck_connection
from tallyline.plans import QUERIES as PLANNED
from tallyline.plans import REPLAYS

DATA = "/root/testdata/sf0.001"
# queries of the subpackage llm are held against brute force in tests/llm
QUERIES = {name: entry.queries()[name] for name in (*PLANNED, *REPLAYS)}
BUILT = {}  # a replay runs its streams while it is built: once is enough


def build(spark, name):
    if name not in BUILT:
        BUILT[name] = QUERIES[name](spark, DATA)
    return BUILT[name]


SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck_connection(DATA)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    res = compare(spark, name, lambda s, d: build(s, name), SQL[name], DATA, con)
    assert res["match"], res


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["contestant_number", "total"]
    assert 0 < len(rows) <= 10


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
                 "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_types_match_sql(spark, con, name):
    spark_types = {c: SPARK_TO_DUCK.get(t, t) for c, t in build(spark, name).dtypes}
    rel = con.sql(SQL[name])
    assert spark_types == dict(zip(rel.columns, [str(t) for t in rel.types]))
