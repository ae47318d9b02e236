import os

import pytest

from wordloom.llm.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_its_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    got, want = QUERIES[name](spark, SF), c.sql(SQL[name])
    order = lambda names: sorted(range(len(names)), key=lambda i: names[i])
    a, b = order(got.columns), order(want.columns)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(repr([r[i] for i in a]) for r in got.collect()) == sorted(repr([r[i] for i in b]) for r in want.fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
