from pathlib import Path

import duckdb
import pytest

from glyphloom.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, tiny, name):
    con = duckdb.connect()
    for p in Path(tiny).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    q = catalog.QUERIES[name](spark, tiny)
    columns = sorted(q.columns)
    c = con.execute(catalog.SQL[name])
    names = [d[0] for d in c.description]
    assert sorted(names) == columns
    assert sorted(repr([r[c] for c in columns]) for r in q.collect()) == sorted(repr([r[names.index(c)] for c in columns]) for r in c.fetchall())


@pytest.mark.parametrize("name", ["p1_found", "p7_found", "p7_counts", "p9_found", "p8_containers", "p6_splits"])
def test_query_runs_without_repeated_rows(spark, tiny, name):
    rows = [tuple(r) for r in catalog.QUERIES[name](spark, tiny).collect()]
    assert len(rows) == len(set(rows))
