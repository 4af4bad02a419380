"""The operators that SQL can say, against it, on whole tables."""

from __future__ import annotations

import duckdb
import pytest

from tabulith.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    frame = queries.queries()[name](spark, folder)
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    assert sorted((tuple(r) for r in frame.select(*names).collect()), key=repr) == sorted(found.fetchall(), key=repr)
