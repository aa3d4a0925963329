from __future__ import annotations

import random
from statistics import median

import numpy as np

from millrace.operators.load_profile import LEVEL, _alone, _areas, _newton, load_changes, load_findings, profile_loads

SCHEMA = "id long, inst string, load int, v double, w double, name string, _entity string, auc double"
RANGES, PATTERNS = {"v": (0, 1), "w": (0, 100)}, {"name": r"\AP[0-9]\z"}


def profile(spark, rows):
    df = spark.createDataFrame([(i, *r, "x", 0.0) for i, r in enumerate(rows)], SCHEMA)
    return profile_loads(df, "inst", "load", "id", RANGES, PATTERNS)


def test_base_aggregates_against_brute_force(spark):
    rng = random.Random(1)
    values = [None, float("nan"), float("inf"), -1.0, 2.0, 0.0, -0.0, 0.25, 0.5]
    rows = [(rng.choice("AB"), rng.randint(1, 3), rng.choice([*values, rng.random()]), None, rng.choice(["P1", "Q", None, ""])) for _ in range(700)]
    rows += [("hot", 1, i / 5000, 1.0, "P1") for i in range(5000)]
    got = {(r.inst, r.load, r.column_name): r for r in profile(spark, rows).collect()}
    for inst, load in {(r[0], r[1]) for r in rows}:
        own = [r for r in rows if r[:2] == (inst, load)]
        seen = [r[2] for r in own if r[2] is not None and r[2] == r[2]]
        inside = [x for x in seen if 0 <= x <= 1]
        r = got[inst, load, "v"]
        assert (r.n_rows, r.n_null, r.n_distinct, r.n_out_of_range) == (len(own), len(own) - len(seen), len(set(seen)), len(seen) - len(inside))
        assert (r.min_value, r.max_value, r.median_in_range) == (min(seen), max(seen), median(inside))
        names = [x[4] for x in own if x[4] is not None]
        r = got[inst, load, "name"]
        assert (r.n_null, r.n_distinct, r.n_pattern, r.kind) == (len(own) - len(names), len(set(names)), sum(n != "P1" for n in names), "text")
    assert got["A", 1, "w"].n_null == got["A", 1, "w"].n_rows and got["A", 1, "w"].median_in_range is None
    assert got["A", 2, "v"].prev_n_rows == got["A", 1, "v"].n_rows and got["A", 1, "v"].prev_n_rows is None


def test_findings(spark):
    rng = random.Random(2)
    rows = []
    for load in range(1, 8):
        for i in range(80):
            v, w = 0.1 + 0.02 * rng.random(), 10 + rng.random()
            if load == 2 and i < 40:
                v = None
            if load == 4:
                w *= 3
            if load == 6:
                v = 0.1
            rows.append(("A", load, 2.0 if load == 7 and i == 0 else v, w, "p1" if load == 3 and i == 1 else "P1"))
    p = profile(spark, rows)
    assert sorted((r.load, r.column_name, r.finding) for r in load_findings(p, "inst", "load").collect()) == [
        (2, "v", "null_rate"), (3, "name", "pattern"), (3, "v", "null_rate"), (4, "w", "shift"), (5, "w", "shift"), (6, "v", "distinct"), (7, "v", "range"),
    ]
    seen = {(r.load, r.column_name): r for r in p.collect()}
    assert seen[4, "w"].auc > 0.95 and seen[4, "w"].auc_alone > 0.95 and seen[4, "w"].auc - seen[4, "w"].auc_without > 0.3
    assert abs(seen[4, "v"].auc_alone - 0.5) < 0.2 and seen[1, "v"].auc is None


def test_shift_among_nulls(spark):
    """Few values among many nulls: the two-sample test often misses what the exact medians tell."""
    few = {f"I{k}": 1 + k % 4 for k in range(24)}
    rows = [(inst, load, (0.05 if load == 1 else 0.5) + i / 1000 if i < n else None, 1.0, "P1") for inst, n in few.items() for load in (1, 2) for i in range(60)]
    found = load_findings(profile(spark, rows), "inst", "load").collect()
    assert sorted((r.inst, r.load, r.column_name, r.finding) for r in found) == sorted((inst, 2, "v", "shift") for inst in few)
    assert all(0 <= r.auc_alone <= 1 for r in found)


def test_edges(spark):
    assert profile(spark, []).count() == 0
    assert load_findings(profile(spark, []), "inst", "load").count() == 0
    p = profile(spark, [(None, 1, 0.5, 1.0, "P1"), (None, 2, 0.5, 1.0, "P1"), ("A", None, 5.0, None, None), ("A", 1, None, None, None)])
    found = {(r.inst, r.load, r.column_name, r.finding) for r in load_findings(p, "inst", "load").collect()}
    assert found == {("A", None, "v", "range")}
    assert p.where("prev_n_rows is not null").count() == 0


def test_regression_and_area():
    rng = np.random.default_rng(0)
    x = np.hstack([np.ones((4000, 1)), rng.normal(size=(4000, 2))])
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 1])))).astype(float)
    beta = _newton(x[None], y[None], np.ones((1, 4000)), np.zeros((1, 3)), 1e-3, 12)[0]
    assert np.allclose(beta, [0.5, 2, 0], atol=0.2)
    s, w = rng.integers(0, 5, 300).astype(float), rng.integers(1, 4, 300).astype(float)
    label = (rng.random(300) < 0.4).astype(float)
    pairs = [(wi * wj, (si > sj) + 0.5 * (si == sj)) for si, wi, li in zip(s, w, label) if li for sj, wj, lj in zip(s, w, label) if not lj]
    assert abs(_areas(s[None], (w * label)[None], (w * (1 - label))[None])[0] - sum(a * b for a, b in pairs) / sum(a for a, _ in pairs)) < 1e-9


def test_level_and_power_of_the_test(spark):
    """Loads without a change are called changed at the stated rate at most, and refused as candidates; doubled medians aren't."""
    rng = random.Random(5)
    same = [(f"S{k}", load, 0.3 + 0.1 * rng.random(), 50 + rng.gauss(0, 4), "P1") for k in range(100) for load in range(1, 5) for _ in range(40)]
    moved = [(f"M{k}", load, (0.2 if load == 1 else 0.5) + 0.1 * rng.random(), 50.0, "P1") for k in range(100) for load in (1, 2) for _ in range(40)]
    got = [r for r in profile(spark, same + moved).collect() if r.kind == "number" and r.auc is not None]
    still = [r for r in got if r.inst[0] == "S"]
    assert len(still) == 600 and sum(r.changed for r in still) <= 600 * LEVEL + 3 * (600 * LEVEL) ** 0.5
    assert sum(r.changed or r.undecided for r in still) <= 0.05 * len(still)
    assert all(r.changed and r.p_value < LEVEL for r in got if r.inst[0] == "M" and r.column_name == "v")


def test_candidates_lose_no_shift(spark):
    """Medians in a gap between two heaps of values: the distributions differ by a row or two, the medians by far."""
    rng = random.Random(6)
    rows, want = [], set()
    for k in range(60):
        loads = {}
        for load in (1, 2, 3):
            low = rng.choice([20, 21, 19, 1, 2]) if k % 2 else rng.randint(0, 3)
            loads[load] = [0.01 + 0.001 * rng.random() for _ in range(low)] + [0.9] * rng.choice([20, 19, 21, 2])
            rows += [(f"G{k}", load, x, 1.0, "P1") for x in loads[load]]
        for load in (2, 3):
            a, b = median(loads[load]), median(loads[load - 1])
            if a > 2 * b or b > 2 * a:
                want.add((f"G{k}", load))
    found = load_findings(profile(spark, rows), "inst", "load").where("finding = 'shift'").collect()
    assert {(r.inst, r.load) for r in found} == want and len(want) > 20


def test_changes(spark):
    rows = [("A", load, None if load == 2 and i % 2 else 0.5, float(i), "P1") for load in (1, 2, 3) for i in range(200)]
    assert {(r.load, r.column_name) for r in load_changes(profile(spark, rows), "inst", "load").collect()} == {(2, "v"), (3, "v")}


def test_permutations_by_brute_force():
    from itertools import combinations
    from statistics import NormalDist

    odds = np.array([1.0, 2, 3, 5, 5, 7])
    ones, zeros = np.array([0.0, 1, 0, 0, 1, 1]), np.array([1.0, 1, 1, 1, 0, 0])
    rows = np.repeat(odds, (ones + zeros).astype(int))

    def area(chosen):
        a, b = rows[list(chosen)], np.delete(rows, list(chosen))
        return ((a[:, None] > b) + (a[:, None] == b) / 2).mean()

    (got,), (z,) = _alone(odds[None], ones[None], zeros[None])
    assert abs(got - area((2, 5, 6))) < 1e-9 or abs(got - area((1, 5, 6))) < 1e-9
    share = np.mean([area(c) >= got - 1e-12 for c in combinations(range(7), 3)])
    assert abs(NormalDist().cdf(float(z)) - (1 - share)) < 1e-9
    (many,), (far,) = _alone(odds[None], 40 * ones[None], 40 * zeros[None])
    assert abs(many - got) < 1e-9 and far > 5
