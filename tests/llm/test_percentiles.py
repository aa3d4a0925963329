from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.percentiles import merge_sketches, percentiles, sketch_columns
from millrace.llm.rank_sketch import ColumnSketch, RankSketch, section_size

SHARES = [0.0, 0.001, 0.01, 0.1, 0.5, 0.9, 0.99, 0.999, 1.0]


def errors(sketch, values):
    """Rank errors, each as a share of the rows beyond the percentile on its nearer side."""
    data = np.sort(values)
    out = []
    for s, v in zip(SHARES, sketch.quantiles(SHARES)):
        lo, hi = np.searchsorted(data, v, "left") + 1, np.searchsorted(data, v, "right")
        wanted = max(1, math.ceil(s * len(data) - 1e-9))
        out.append(max(0, lo - wanted, wanted - hi) / max(1.0, min(s, 1 - s) * len(data)))
    return out


@pytest.mark.parametrize("kind", ["normal", "heavy", "ties", "sorted", "reversed"])
@pytest.mark.parametrize("parts", [1, 7, 150])
def test_error_bound(kind, parts):
    rng = np.random.default_rng(parts)
    n = 150_000
    values = {"normal": lambda: rng.normal(size=n), "heavy": lambda: rng.pareto(0.5, n), "ties": lambda: rng.integers(0, 40, n) * 1.0, "sorted": lambda: np.arange(n) * 1.0, "reversed": lambda: np.arange(n)[::-1] * 1.0}[kind]()
    eps, whole = 0.02, None
    for part in np.array_split(values, parts):
        s = ColumnSketch(section_size(eps))
        for piece in np.array_split(part, max(1, len(part) // 977)):
            s.update(piece)
        s = ColumnSketch.from_bytes(s.to_bytes())
        if whole is None:
            whole = s
        else:
            whole.merge(s)
    assert whole.n == n and max(errors(whole, values)) <= eps
    assert len(whole.to_bytes()) < 80_000
    assert all(sum(len(x[3]) << h for h, x in enumerate(t.levels)) == n for t in whole.stacks)


def test_few_values_are_exact():
    values = np.random.default_rng(0).normal(size=200)
    s = ColumnSketch(section_size(0.01))
    s.update(values[:150])
    other = ColumnSketch(section_size(0.01))
    other.update(values[150:])
    s.merge(ColumnSketch.from_bytes(other.to_bytes()))
    assert max(errors(s, values)) == 0
    assert all(math.isnan(x) for x in ColumnSketch(4).quantiles([0.5])) and ColumnSketch.from_bytes(ColumnSketch(4).to_bytes()).n == 0


def test_one_tail_and_parameters():
    values = np.random.default_rng(1).exponential(size=100_000)
    for tail, at in (("high", 0.9999), ("low", 0.0001)):
        s = RankSketch(section_size(0.02), tail)
        for piece in np.array_split(values, 100):
            s.update(piece)
        rank = np.searchsorted(np.sort(values), s.quantiles([at])[0]) + 1
        assert abs(rank - math.ceil(at * len(values))) <= 1
    with pytest.raises(ValueError, match="different"):
        ColumnSketch(4).merge(ColumnSketch(6))
    with pytest.raises(ValueError, match="eps"):
        section_size(0)


def test_same_states_give_the_same_sketch():
    values = np.random.default_rng(2).normal(size=50_000)
    made = []
    for _ in range(2):
        s = ColumnSketch(8)
        for piece in np.array_split(values, 60):
            s.update(piece)
        made.append(s.to_bytes())
    assert made[0] == made[1]


def test_by_group_and_day(spark):
    rng = random.Random(5)
    rows = []
    for i in range(30_000):
        chrom = "hot" if i % 3 else rng.choice(["a", "b", None])
        rows.append((chrom, rng.randint(1, 3), rng.choice([None, float("nan"), float("inf"), rng.gauss(0, 1)]) if i % 5 == 0 else rng.gauss(5, 2), None, i))
    df = spark.createDataFrame(rows, "chrom string, day int, v double, none double, n long").repartition(6)
    days = sketch_columns(df, ["day", "chrom"], ["v", "none"], 0.02)
    assert {r.column_name for r in days.select("column_name").distinct().collect()} == {"v"}
    shares = {f"p{i}": s for i, s in enumerate(SHARES)}
    whole = percentiles(merge_sketches(days, ["chrom"], many=True, fan_in=2), ["chrom"], shares).collect()
    assert {r.chrom for r in whole} == {"hot", "a", "b", None}
    for r in whole:
        values = np.array([v for c, _, v, _, _ in rows if c == r.chrom and v is not None and v == v])
        assert r.n == len(values)
        fake = type("S", (), {"quantiles": lambda self, s, r=r: [r[f"p{i}"] for i in range(len(s))]})()
        assert max(errors(fake, values)) <= 0.02
    again = percentiles(merge_sketches(days, ["chrom"], many=True, fan_in=2), ["chrom"], shares).collect()
    assert sorted(map(str, whole)) == sorted(map(str, again))
    assert percentiles(days, ["day", "chrom"], shares).count() == 12


def test_edges(spark):
    df = spark.createDataFrame([], "g string, v double, n long, column_name string, part int")
    assert percentiles(sketch_columns(df, ["g"], ["v"]), ["g"], {"p": 0.5}).count() == 0
    one = spark.createDataFrame([("x", 3.0, 1, "a", 2)], df.schema)
    got = percentiles(sketch_columns(one, ["g"], ["v", "n"]), ["g"], {"p": 0.5}).orderBy("column_name").collect()
    assert [tuple(r) for r in got] == [("x", "n", 1, 1.0), ("x", "v", 1, 3.0)]
    assert percentiles(sketch_columns(one, [], ["v"]), [], {"p": 0.5}).first().p == 3.0
    assert F is not None


def test_many_small_groups_are_handed_on_in_time(monkeypatch):
    import pandas as pd

    from millrace.llm import percentiles as P

    monkeypatch.setattr(P, "HELD", 400_000)
    batches = [pd.DataFrame({"k": np.arange(i, i + 500), "v": 1.0}) for i in range(0, 5000, 500)]
    out = list(P._build(iter(batches), ["k"], ["v"], "both", 50))
    assert len(out) > 5 and sum(map(len, out)) == 5000 and max(map(len, out)) < 700
    one = ColumnSketch(50)
    for x in range(200):
        one.update(np.array([float(x)]))
    assert one.held() < 6_000


def test_two_rounds_of_merging(spark):
    df = spark.range(0, 60_000, 1, 12).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    sketches = sketch_columns(df, ["k"], ["v"])
    parts = [sketch_columns(df.where(f"pmod(v, 5) = {i}"), ["k"], ["v"]) for i in range(5)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    for many in (False, True):
        got = {r.k: r for r in percentiles(merge_sketches(whole, ["k"], many=many, fan_in=2), ["k"], {"p50": 0.5}).collect()}
        assert all(got[k].n == 20_000 and abs(got[k].p50 - 30_000) < 300 for k in range(3))
    assert sketches.count() == 3
