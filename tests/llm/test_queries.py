"""Every registered query of the subpackage on the smallest tables: equal to its SQL, or one row for each row of its table."""

import duckdb
import pytest

from texloom.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "benchmark", "pages", "embeddings", "labels"]
#: Table whose rows the result has, for queries without SQL.
ROWS = {"op2_pii": "documents", "op4_bpe": "documents", "op7_near_dedup": "documents", "op8_quality_rules": "documents", "op10_quality_crf": "documents"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, db, name):
    want = db.execute(queries.ORACLE_SQL[name])
    columns = sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(c) for c in columns]
    got = queries.QUERIES[name](spark, SF)
    assert set(columns) <= set(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(ROWS))
def test_query_has_a_row_for_each_row(spark, db, name):
    table, key = ROWS[name], "doc_id"
    got = queries.QUERIES[name](spark, SF)
    want = sorted(r[0] for r in db.execute(f"select {key} from {table}").fetchall())
    assert sorted(r[0] for r in got.select(key).collect()) == want


def test_all_queries_are_held_here():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL) | set(ROWS) | {"op13_whitening"}  # the last in its own tests
