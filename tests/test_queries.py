"""Every query with SQL against the same SQL in another engine, on the smallest data."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from foliospark.plans import registry

DATA = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    if isinstance(v, (int, float, Decimal)):
        return "nan" if isinstance(v, float) and math.isnan(v) else repr(round(float(v), 6))
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = sorted(tuple(map(plain, r)) for r in con.sql(f"select {quoted} from ({SQL[name]})").fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_others_give_rows(spark, name):
    df = registry.queries()[name](spark, DATA)
    rows = df.collect()
    assert rows and all(any(v is not None for v in r) for r in rows)
    keys = {"p4_found": ["response_id", "child", "line_pos", "pos"], "p4_nodes": ["response_id", "pre"], "p5_found": ["line_id"], "p5_unit_shifts": ["source", "segment"], "extract_structured": ["doc_id"], "rich_responses": ["doc_id"]}.get(name)
    assert keys is None or len({tuple(r[k] for k in keys) for r in rows}) == len(rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
