"""Every library query that has SQL gives DuckDB's rows; the others run and are stable."""

import glob
import math
import os

import duckdb
import pytest

from cadenza.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: No row at the smallest scale: few events, few bytes.
EMPTY = {"stm09_suffix_scan", "win28_evict_oldest"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(f).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}{'/*' if os.path.isdir(f) else ''}')")
    return con


def plain(x):
    if isinstance(x, (list, tuple)):
        return str([plain(v) for v in x])
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float) and math.isnan(x):
        return None
    return float(x) if isinstance(x, (int, float)) or type(x).__name__ == "Decimal" else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    assert got or name in EMPTY
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows(columns, found.fetchall())
    else:
        assert got == rows(df.columns, QUERIES[name](spark, SF).collect())
