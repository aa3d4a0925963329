from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.plans.engine import Engine
from millrace.streaming.programs import drain, fold_windows, over_stream


def source(spark, path):
    return spark.readStream.schema("t timestamp, k string, v long").parquet(path)


@pytest.fixture
def events(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", k, v) for m, k, v in [(1, "a", 1), (2, "b", 2), (11, "a", 3), (12, "a", 4), (59, "b", 5)]]
    spark.createDataFrame(rows, "t string, k string, v long").selectExpr("cast(t as timestamp) as t", "k", "v").write.parquet(f"{tmp_path}/in")
    return f"{tmp_path}/in"


def test_program_over_a_stream(spark, events, tmp_path):
    engine = Engine(spark)
    out = over_stream(engine, "s", source(spark, events), "s | filter(&v > 1) | reduce(&k, |a,b| a+b, map:=&v)")
    drain(out, "folded", f"{tmp_path}/c1", "complete")
    assert {r.key: r.value for r in spark.table("folded").collect()} == {"a": 7, "b": 7}
    with pytest.raises(ValueError, match="isn't a stream"):
        over_stream(engine, "q", spark.range(1), "q")


def test_windows(spark, events, tmp_path):
    out = fold_windows(source(spark, events), "t", "10 minutes", F.col("k"), F.col("v"), "+", "5 minutes")
    drain(out, "windows", f"{tmp_path}/c2")
    got = {(r.window_start.minute, r.key): r.value for r in spark.table("windows").collect()}
    assert got[0, "a"] == 1 and got[0, "b"] == 2 and got[10, "a"] == 7
