from __future__ import annotations

import random

import pytest

from millrace.llm.top_items import top_items

SCHEMA = "g string, x double, id long, rank_no string, _g string, _band int"


def brute(rows, n):
    by = {}
    for g, x, i, *_ in rows:
        if g is not None and x is not None and x == x and i is not None:
            by.setdefault(g, []).append((-x, i))
    return sorted((g, r + 1, i) for g, own in by.items() for r, (_, i) in enumerate(sorted(own)[:n]))


def found(spark, rows, n, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((r.g, r["rank_no"], r.id) for r in top_items(df, "g", "x", "id", n, **more).collect())


def sample(seed, size=3000):
    rng = random.Random(seed)
    rows = []
    for i in range(size):
        g = "hot" if i % 3 == 0 else rng.choice([None, "", *(f"g{k}" for k in range(600))])
        rows.append((g, rng.choice([None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1.0, rng.gauss(0, 3)]), i, "r", "x", 9))
    return rows + rows[:200]


@pytest.mark.parametrize("n", [1, 3, 50])
@pytest.mark.parametrize("broadcast_bytes", [0, 2_000, 4_000_000])
def test_against_brute_force(spark, n, broadcast_bytes):
    rows = sample(n)
    assert found(spark, rows, n, broadcast_bytes=broadcast_bytes) == brute(rows, n)


def test_bands_of_ties(spark):
    rows = [("hot", 7.0, i, "", "", 0) for i in range(2000)] + [(f"g{i}", 7.0, i, "", "", 0) for i in range(50)] + [("hot", 8.0, 5000, "", "", 0)]
    assert found(spark, rows, 4, shares=(0.01, 0.2, 0.6)) == brute(rows, 4)


def test_many_items(spark):
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
    try:
        rows = sample(8, 1500)
        assert found(spark, rows, 40) == brute(rows, 40)
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_edges(spark):
    assert found(spark, [], 3) == []
    assert found(spark, [(None, 1.0, 1, "", "", 0), ("a", None, 1, "", "", 0), ("a", float("nan"), 1, "", "", 0), ("a", 1.0, None, "", "", 0)], 3) == []
    assert found(spark, [("a", 1.0, 5, "", "", 0)] * 3, 2) == [("a", 1, 5), ("a", 2, 5)]
    long = "x" * 1_000_000
    assert found(spark, [(long, 1.0, 1, "", "", 0), (long, 2.0, 2, "", "", 0)], 1) == [(long, 1, 2)]
    with pytest.raises(ValueError, match="at least 1"):
        top_items(spark.createDataFrame([], SCHEMA), "g", "x", "id", 0)
