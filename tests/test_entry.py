"""The driver's entry points, and a few registered queries against their SQL."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["coupling", "find_layer_violations", "call_site_merge", "find_cycles", "impact_of_diff", "owner_of", "clone_pair", "route_suffix", "shared_ids", "resolve_calls", "health", "report", "sec_summary", "debt_summary", "clone_summary", "clone_clusters", "body_hash"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")

    def rows(df):
        plain = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
        cols = sorted(df.columns)
        return sorted(repr([plain(v) for v in r]) for r in df[cols].astype(object).where(df[cols].notna(), None).values.tolist())

    assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(con.sql(entry.oracle_sql()[name]).df())
