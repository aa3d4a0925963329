"""The driver contract, and every query against its SQL on the smallest tables."""

from __future__ import annotations

import os
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as contract

FOLDER = os.environ.get("MILLRACE_TESTDATA", "/root/testdata/sf0.001")
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def text(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and np.isnan(v):
        return "~"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.number)):
        return f"{float(v):.9g}"
    return pd.Timestamp(v).isoformat() if hasattr(v, "isoformat") else str(v)


def canonical(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False))


def test_contract(spark):
    assert set(ORACLES) <= set(QUERIES)
    if Path("/root/testdata/sf0.001").exists():
        assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)
    else:
        assert len(got.columns) > 0
