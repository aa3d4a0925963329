"""Operators over DataFrames, against brute force."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import nulls, scalar
from millrace.operators import collapse, groups, intervals, joins, reshape, rows


def key(v):
    return tuple((x is None, x if x is not None else 0) for x in v)


VALUES = (None, 1, 2)


@pytest.mark.parametrize(
    ("name", "model"),
    [
        ("eq", lambda x, y: x == y), ("ne", lambda x, y: x != y), ("gt", lambda x, y: key([x]) > key([y])), ("ge", lambda x, y: key([x]) >= key([y])),
        ("eq_or_right_null", lambda x, y: x is not None and (y is None or x == y)), ("eq_or_left_null", lambda x, y: y is not None and (x is None or x == y)),
        ("eq_or_either_null", lambda x, y: x is None or y is None or x == y),
    ],
)
def test_comparisons(spark, name, model):
    df = spark.createDataFrame(list(itertools.product(VALUES, VALUES)), "x int, y int")
    for r in df.withColumn("z", getattr(nulls, name)(F.col("x"), F.col("y"))).collect():
        assert r.z is model(r.x, r.y), r
    if name in ("gt", "ge"):
        kept = df.where(getattr(nulls, f"where_{name}")(F.col("x"), F.col("y"))).collect()
        assert {tuple(r) for r in kept} == {p for p in itertools.product(VALUES, VALUES) if model(*p)}


def simulated(left, right, op):
    """Joins as a merge of keys: partners of equal keys, or none; then the condition, a missing side being missing values."""
    out = []
    test = {
        "==": lambda x, y: x == y,
        "==?": lambda x, y: x is not None and (y is None or x == y),
        "?==": lambda x, y: y is not None and (x is None or x == y),
        "?==?": lambda x, y: x is None or y is None or x == y,
    }[op]
    for k in {x for x, _ in left} | {y for y, _ in right}:
        ls, rs = [r for r in left if r[0] == k] or [(None, None)], [r for r in right if r[0] == k] or [(None, None)]
        out += [(*x, *y) for x in ls for y in rs if test(x[0], y[0])]
    return sorted(out, key=key)


@pytest.mark.parametrize("op", list(joins.KINDS))
@pytest.mark.parametrize("seed", range(3))
def test_joins_against_simulation(spark, op, seed):
    rng = random.Random(seed)
    left = [(rng.choice([None, 1, 2, 3] if seed else [1, 2]), i) for i in range(7)]
    right = [(rng.choice([None, 2, 3, 4] if seed == 1 else [2, 3, 4]), 100 + i) for i in range(6)]
    a, b = spark.createDataFrame(left, "x int, i int"), spark.createDataFrame(right, "y int, j int")
    got = joins.join_tables({"a": a, "b": b}, [joins.Match("a", "x", op, "b", "y")], null_extend=True)
    assert got.columns == ["a_x", "a_i", "b_y", "b_j"]
    assert sorted([tuple(r) for r in got.collect()], key=key) == simulated(left, right, op)


def test_inner_joins_read_each_table_once(spark, tmp_path):
    for name, keys in (("a", [1, 2]), ("b", [2, 3]), ("n", [2, None])):
        spark.createDataFrame([(k, f"{name}{k}") for k in keys], "k int, t string").write.parquet(f"{tmp_path}/{name}")
    a, b, n = (spark.read.parquet(f"{tmp_path}/{x}") for x in "abn")

    def plan(*tables):
        out = joins.join_tables(dict(zip("xyz", tables)), [joins.Match(u, "k", "==", v, "k") for u, v in zip("xyz", "yz"[: len(tables) - 1])], null_extend=True)
        return out, out._jdf.queryExecution().optimizedPlan().toString()

    got, text = plan(a, b)
    assert text.count("Relation [") == 2 and "Inner" in text and "<=>" not in text and got.count() == 1
    got, text = plan(n, b)
    assert text.count("Relation [") == 2 and "FullOuter" in text
    assert sorted((r.x_t, r.y_t or "") for r in got.collect()) == [("n2", "b2"), ("nNone", "")]
    # Of three tables, a row with a missing key comes out with none of the other two; one whose partner has other keys doesn't.
    got, text = plan(n, b, b)
    assert text.count("Relation [") == 3 and sorted((r.x_t, r.z_t or "") for r in got.collect()) == [("n2", "b2"), ("nNone", "")]
    assert not joins.null_keys({"x": a, "y": b}, [joins.Match("x", "k", "==", "y", "k")])
    assert joins.null_keys({"x": a.distinct(), "y": b}, [joins.Match("x", "k", "==", "y", "k")])


def test_join_limits_and_helpers(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    with pytest.raises(ValueError, match="up to 4"):
        joins.join_tables({str(i): df for i in range(5)}, [])
    other = spark.createDataFrame([(1,), (None,)], "y int")
    assert joins.anti_join(df, other.where("y = 2"), F.col("x"), F.col("y")).count() == 1
    assert joins.semi_join(df, other, F.col("x"), F.col("y")).count() == 2
    assert joins.join_tables({"a": df, "b": other}, []).count() == 4
    assert joins.join_tables({"a": df, "b": other.where("false")}, []).count() == 0


@pytest.mark.parametrize("bits", [1, 4, 17])
def test_overlaps_against_brute_force(spark, bits):
    rng = random.Random(bits)

    def some(n):
        out = []
        for i in range(n):
            s = rng.choice([None, rng.randint(-40, 200), rng.randint(-40, 200)])
            out.append((i, rng.choice(["a", "b", None]), s, None if s is None else s + rng.choice([-2, 0, 1, 9, 70, 3_000])))
        return [*out, (n, "a", 0, 2**62), (n + 1, "b", -(2**63), 2**63 - 1), (n + 2, "a", 2**62 - 1, 2**62 + 5)]

    left, right = some(150), some(60)
    df = spark.createDataFrame(left, "n int, chrom string, start long, end long").withColumn("__s", F.lit(1)).withColumn("__r", F.lit("x"))
    features = spark.createDataFrame([(c, s, e, n) for n, c, s, e in right], "chrom string, start long, end long, n int")

    def hit(x, y):
        return x[1] is not None and x[1] == y[1] and None not in (x[2], y[2]) and x[3] > x[2] and y[3] > y[2] and x[2] < y[3] and y[2] < x[3]

    pairs = {(x[0], y[0]) for x in left for y in right if hit(x, y)}
    args = (df, features, F.col("chrom"), F.col("start"), F.col("end"))
    assert sorted(r.n for r in intervals.overlap_join(*args, bits=bits).collect()) == sorted({x for x, _ in pairs})
    got = intervals.overlap_join(*args, lambda r, f: F.struct(r["n"].alias("x"), f["n"].alias("y")), bits)
    assert sorted(tuple(r) for r in got.collect()) == sorted(pairs)
    assert intervals.overlap_join(*args[:1], features.where("false"), *args[2:], bits=bits).count() == 0


@pytest.mark.parametrize("partitions", ["1", "5"])
def test_folds(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rng = random.Random(3)
        data = [(rng.choice([None, 1, 2, 3]), rng.randint(0, 50)) for _ in range(500)]
        df = spark.createDataFrame(data, "k int, v int").repartition(4)
        for how, model in (("+", sum), ("max", max), ("min", min)):
            assert {r.key: r.value for r in groups.fold(df, F.col("k"), F.col("v"), how).collect()} == {k: model(v for x, v in data if x == k) for k in (None, 1, 2, 3)}
        own = groups.fold(df, F.col("k"), F.col("v"), lambda a, b: a + b)
        assert {r.key: r.value for r in own.collect()} == {k: sum(v for x, v in data if x == k) for k in (None, 1, 2, 3)}
        assert groups.fold(df.where("false"), F.col("k"), F.col("v"), lambda a, b: a + b).count() == 0
        listed = groups.group_rows(spark.createDataFrame(data, "k int, v int"), F.col("k"), F.col("v"))
        assert {r.key: r.value for r in listed.collect()} == {k: [v for x, v in data if x == k] for k in (None, 1, 2, 3)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_hot_key_is_folded_in_short_lists(spark):
    df = spark.range(0, 300_000, 1, 6).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    out = groups.fold(df, F.col("k"), F.col("v"), lambda a, b: F.when(a > b, a).otherwise(b))
    assert out.where("key = 0").first().value == 299_997 and out.count() == 200_001
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_greatest_of_a_group_with_a_missing_value(spark):
    df = spark.createDataFrame([(1, 5), (1, None), (2, 5)], "k int, v int")
    assert {r.key: r.value for r in groups.fold(df, F.col("k"), F.col("v"), "max").collect()} == {1: None, 2: 5}


@pytest.mark.parametrize("seed", range(12))
def test_collapse_against_brute_force(spark, seed):
    """Runs over many partitions, entered in every way; nested cells; whole tables of one run."""
    rng = random.Random(seed)
    keys, n, parts = [["a", "b", None], ["a"], ["a"] * 30 + ["b"]][seed % 3], rng.choice([1, 5, 40, 90]), rng.choice([1, 3, 9])
    data = [(rng.choice(keys), rng.choice([None, None, 1]), rng.choice([None, None, None, 2]), rng.choice([None, None, [3]])) for _ in range(n)]
    want = []
    for k, *cells in data:
        if want and want[-1][0] == k and not any(x is not None and y is not None for x, y in zip(want[-1][1], cells)):
            want[-1] = (k, [y if x is None else x for x, y in zip(want[-1][1], cells)])
        else:
            want.append((k, cells))
    df = spark.createDataFrame(spark.sparkContext.parallelize(data, parts), "k string, x int, y int, z array<int>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rng.choice(["2", "7", "10000"]))
    try:
        assert [(r.k, [r.x, r.y, r.z]) for r in collapse.collapse(df, ["x", "y", "z"]).collect()] == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    if len(keys) == 1:
        assert [[r.x, r.y, r.z] for r in collapse.collapse(df.drop("k"), ["x", "y", "z"]).collect()] == [c for _, c in want]


def test_collapse_neither_shuffles_nor_sorts(spark, tmp_path):
    spark.range(10).selectExpr("id div 2 as k", "if(id % 2 = 0, id, null) as x", "if(id % 2 = 1, id, null) as y").write.parquet(f"{tmp_path}/t")
    plan = collapse.collapse(spark.read.parquet(f"{tmp_path}/t"), ["x", "y"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    assert collapse.collapse(spark.read.parquet(f"{tmp_path}/t").where("k < 0"), ["x", "y"]).count() == 0


def test_dense_order(spark):
    df = rows.dense_order(spark.range(0, 1000, 1, 7).where("id % 3 = 0"))
    assert [(r.id, r["__row"]) for r in df.collect()] == [(3 * i, i) for i in range(334)]
    assert rows.dense_order(spark.range(0)).count() == 0


def test_reshape_edges(spark):
    df = spark.createDataFrame([("a", "x", 1), ("b", None, 2), ("c", "y", None)], "k string, n string, v int")
    wide = reshape.spread(df, "n", "v")
    assert [tuple(r) for r in wide.orderBy("k").collect()] == [("a", 1, None), ("b", None, None), ("c", None, None)] and wide.columns == ["k", "x", "y"]
    assert reshape.gather(df.where("false"), ["v"], "key", "value").count() == 0
    with pytest.raises(ValueError, match="no such columns"):
        reshape.gather(df, ["q"], "key", "value")
    with pytest.raises(ValueError, match="one column"):
        reshape.flatten(df)
    assert reshape.concat(df, df.drop("v")).count() == 6


@pytest.mark.parametrize(
    ("x", "text"),
    [(123.0, "123"), (0.5, "0.5"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (1.25e-7, "1.25e-07"), (0.0001, "0.0001"), (-1.5e7, "-15000000"), (float("inf"), "+Inf"), (float("nan"), "NaN"), (None, "")],
)
def test_float_text(spark, x, text):
    df = spark.createDataFrame([(x,)], "x double")
    assert df.select(scalar.to_string(F.col("x"), df.schema[0].dataType)).first()[0] == text


def test_bytes_and_regexes(spark):
    df = spark.createDataFrame([("añb",), ("",), (None,)], "s string")
    got = df.select(scalar.string_len(F.col("s")), scalar.substring(F.col("s"), F.lit(1), F.lit(3)), scalar.string_count(F.col("s"), F.lit(""))).collect()
    assert [tuple(r) for r in got] == [(4, "ñ", 4), (0, "", 1), (None, None, None)]
    with pytest.raises(ValueError, match="look-around"):
        scalar.regexp_match(F.col("s"), "a(?=b)")
    order = spark.createDataFrame([(x,) for x in ("bb", "b", "", "a", "ab")], "s string").orderBy(scalar.negated_text(F.col("s")))
    assert [r.s for r in order.collect()] == ["bb", "b", "ab", "a", ""]


def test_top_n_is_no_full_sort(spark):
    plan = rows.min_rows(spark.range(100), 5, F.col("id"))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
