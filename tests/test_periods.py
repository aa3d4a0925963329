from __future__ import annotations

import random

import pytest

from millrace.operators.periods import periods_and_gaps

SCHEMA = "run long, chrom string, s long, e long, _s string, kind string, _b int"


def brute(rows):
    by = {}
    for run, chrom, s, e, *_ in rows:
        if run is not None and chrom is not None and s is not None and e is not None and e > s:
            by.setdefault((run, chrom), []).append((s, e))
    out = []
    for key, spans in by.items():
        end = None
        for s, e in sorted(spans):
            if end is None or s > end:
                if end is not None:
                    out += [(*key, "period", start, end), (*key, "gap", end, s)]
                start, end = s, e
            else:
                end = max(end, e)
        out.append((*key, "period", start, end))
    return sorted(out)


def found(spark, rows, bits):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in periods_and_gaps(df, ["run", "chrom"], "s", "e", bits).collect())


@pytest.mark.parametrize("bits", [0, 3, 6, 22])
@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, bits, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(600):
        s = rng.choice([None, rng.randint(-300, 300), rng.randint(-300, 300)])
        e = None if s is None or rng.random() < 0.05 else s + rng.choice([-3, 0, 1, 2, 5, 60])
        rows.append((rng.choice([1, 1, 1, 2, None]), rng.choice(["a", "a", "b", None, ""]), s, e, "x", "y", 1))
    rows += rows[:100]
    assert found(spark, rows, bits) == brute(rows)


def test_edges(spark):
    assert found(spark, [], 4) == []
    assert found(spark, [(1, "c", 5, 5, None, None, None), (1, "c", None, 3, None, None, None)], 4) == []
    most = 2**63 - 1
    rows = [(1, "c", -(2**62), 0, None, None, None), (1, "c", 0, 7, None, None, None), (1, "c", 9, most, None, None, None)]
    assert found(spark, rows, 40) == [(1, "c", "gap", 7, 9), (1, "c", "period", -(2**62), 7), (1, "c", "period", 9, most)]


def test_one_interval_over_many_buckets(spark):
    rows = [(1, "c", 0, 10_000, None, None, None)] + [(1, "c", i, i + 1, None, None, None) for i in range(0, 10_200, 2)]
    assert found(spark, rows, 4) == brute(rows)
