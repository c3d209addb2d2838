"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from quotelens.plans import display_queries, ledger_queries, span_queries, table_queries, text_queries  # noqa: F401
from quotelens.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        return
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(names) == sorted(df.columns)
    at = {c: i for i, c in enumerate(names)}
    cols = sorted(df.columns)
    assert sorted(tuple(plain(r[c]) for c in cols) for r in rows) == sorted(tuple(plain(r[at[c]]) for c in cols) for r in want)
