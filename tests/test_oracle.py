"""Registered queries vs their DuckDB oracles on the sf0.001 tables."""
import os
import sys
from collections import Counter

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as E  # noqa: E402
from scripts.check_oracle import TABLES, norm  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", [n for n in E.oracle_sql() if not n.startswith("op")])
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = df.columns
    got = Counter(tuple(norm(r[c]) for c in sorted(cols)) for r in df.collect())
    rel = con.sql(E.oracle_sql()[name])
    dcols = rel.columns
    assert sorted(cols) == sorted(dcols)
    order = sorted(range(len(dcols)), key=lambda i: dcols[i])
    exp = Counter(tuple(norm(r[i]) for i in order) for r in rel.fetchall())
    assert got == exp
