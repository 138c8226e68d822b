import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from texloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    want = db.sql(catalog.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    names = want.columns
    a = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    b = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall())
    assert a == b


def test_queries_without_sql(spark):
    for name in sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)):
        assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_plans(spark):
    """Counts before the shuffle, pruned columns, and no Python in the expression queries."""
    text = catalog.term_topk(spark, SF)._jdf.queryExecution().toString()
    assert "partial_count" in text and "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in text
    assert "WindowGroupLimit" in text
    for name in ("fix_outcome", "retranslation_rollup", "reconcile_tasks", "escape_specials"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan
