"""Every query of the engine against its SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from tabulith import queries as core

QUERIES, SQL = core.queries(), core.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    return str(v) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def compare(spark, sf_dir, duck, query, sql):
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, duck, name):
    compare(spark, sf_dir, duck, QUERIES[name], SQL[name])


def test_fuzzy_candidates_by_plain_python(spark, sf_dir):
    from difflib import SequenceMatcher

    rows = QUERIES["match_fuzzy"](spark, sf_dir).collect()
    assert rows
    for r in rows:
        a, b = ("".join(c for c in x.lower() if c.isalnum()) for x in (r.location, r.alias))
        assert round(SequenceMatcher(None, a, b).ratio(), 6) == r.ratio >= 0.78


@pytest.fixture
def beyond(spark, tmp_path):
    """A maker of a table whose keys are given, as a folder and a DuckDB connection."""

    def make(table, frame):
        frame.write.parquet(f"{tmp_path}/{table}.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        return str(tmp_path), con

    return make


def keys_past_a_sheet(spark):
    """Keys at the start, around a sheet's last row, and past 32 bits."""
    starts = spark.createDataFrame([(0,), (1_048_560,), (9_000_000,), (2_147_483_640,), (5_000_000_000,)], "start long")
    return spark.range(40).crossJoin(starts).selectExpr("id + start AS o_orderkey", "id AS o_custkey")


def test_formula_regions_past_a_sheets_last_row(spark, beyond):
    compare(spark, *beyond("orders", keys_past_a_sheet(spark)), QUERIES["formula_regions"], SQL["formula_regions"])


def test_formula_scan_past_a_sheets_last_row(spark, beyond):
    compare(spark, *beyond("orders", keys_past_a_sheet(spark)), QUERIES["formula_scan"], SQL["formula_scan"])


def test_health_scan_of_a_long_sheet(spark, beyond):
    """Over 100,000 cells: every row is scanned."""
    parts = spark.range(50_100).selectExpr("id AS p_partkey", "'large ring' AS p_name", "id % 50 + 1 AS p_size")
    compare(spark, *beyond("part", parts), QUERIES["health_scan"], SQL["health_scan"])
