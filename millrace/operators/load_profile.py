"""Data-quality profile of the loads of a table, and what changed since the load before."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut

#: 1 / the relative rank error of the percentile sketches that bracket the exact median.
SKETCH_ACCURACY = 10_000
#: A load's rows are joined with its aggregates in so many parts, so that one load with a third of all rows is spread over as many tasks.
SALTS = 8
#: Level of the two-sample test: the share of columns that is called changed where both loads are drawn from one distribution is this at most.
LEVEL = 0.01
#: Folds with fewer rows are tested against all permutations of their labels, one by one, larger ones by the normal limit of these.
EXACT_ROWS = 30


def _clean(value: Column) -> Column:
    number = value.cast("double")
    return F.when(~F.isnan(number), F.when(number == 0.0, F.lit(0.0)).otherwise(number))


def _joined(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by keys of which missing ones are equal."""
    b = b.withColumnsRenamed({k: f"_right{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_right{k}"))
    return a.join(b, condition, how).drop(*[f"_right{k}" for k in keys])


def _loads(df: DataFrame, ranges: dict[str, tuple[float, float]], patterns: dict[str, str]) -> DataFrame:
    """One row for each load with the aggregates of all columns: ``_n``, and by number of the column ``_k_`` values, ``_min_``, ``_max_``, ``_out_`` of and ``_in_`` the range,
    ``_q_``: the tenths inside the range and two ranks close to the middle; ``_tk_`` texts and ``_off_`` against the pattern."""
    aggs = [F.count("*").alias("_n")]
    shares = F.array(*[F.lit(k / 10) for k in range(1, 10)], F.lit(0.5 - 2 / SKETCH_ACCURACY), F.lit(0.5 + 2 / SKETCH_ACCURACY))
    for i, (lo, hi) in enumerate(ranges.values()):
        v, inside = F.col(f"_v_{i}"), F.col(f"_v_{i}").between(float(lo), float(hi))
        aggs += [
            F.count(v).alias(f"_k_{i}"), F.min(v).alias(f"_min_{i}"), F.max(v).alias(f"_max_{i}"), F.count_if(v.isNotNull() & ~inside).alias(f"_out_{i}"),
            F.count_if(inside).alias(f"_in_{i}"), F.percentile_approx(F.when(inside, v), shares, SKETCH_ACCURACY).alias(f"_q_{i}"),
        ]
    for i, pattern in enumerate(patterns.values()):
        t = F.col(f"_t_{i}")
        aggs += [F.count(t).alias(f"_tk_{i}"), F.count_if(~t.rlike(pattern)).alias(f"_off_{i}")]
    return df.groupBy("_entity", "_load").agg(*aggs)


def _with_loads(df: DataFrame, loads: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with columns of their load, in SALTS parts of each load."""
    salted = loads.select("_entity", "_load", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), *columns)
    return _joined(df, salted, ["_entity", "_load", "_salt"])


def _distinct_and_median(rows: DataFrame, df: DataFrame, ranges: dict[str, tuple[float, float]], patterns: dict[str, str]) -> DataFrame:
    """``_entity``, ``_load``, ``_c`` (the number of the column, texts after numbers), ``n_distinct`` and the exact ``median_in_range``.

    One row for each value of a load, however often it occurs, is shuffled; then all values but those between the sketch's two ranks close to the middle collapse to one row for those below
    and one for the rest, already before the next shuffle. What is sorted is 4 / SKETCH_ACCURACY of a load at most.
    """
    group = ["_entity", "_load", "_c"]
    cells = [
        F.struct(F.lit(i).alias("_c"), F.col(f"_v_{i}").alias("_v"), F.col(f"_v_{i}").between(float(lo), float(hi)).alias("_inside"), F.get(f"_q_{i}", F.lit(9)).alias("_a"), F.get(f"_q_{i}", F.lit(10)).alias("_z"))
        for i, (lo, hi) in enumerate(ranges.values())
    ]
    found = []
    if cells:
        long = rows.select("_entity", "_load", F.explode(F.array(*cells)).alias("_x")).select("_entity", "_load", "_x.*").where(F.col("_v").isNotNull())
        values = long.groupBy(*group, "_v", "_inside", "_a", "_z").agg(F.count("*").alias("_n"))
        place = F.when(~F.col("_inside") | (F.col("_v") > F.col("_z")), 2).when(F.col("_v") < F.col("_a"), 0).otherwise(1)
        few = values.withColumn("_place", place).groupBy(*group, "_place", F.when(place == 1, F.col("_v")).alias("_v"))
        few = few.agg(F.sum("_n").alias("_n"), F.count("*").alias("_d"), F.sum(F.when(F.col("_inside"), F.col("_n")).otherwise(0)).alias("_m"))
        upto = F.sum("_m").over(Window.partitionBy(*group).orderBy("_place", "_v").rowsBetween(Window.unboundedPreceding, 0))
        few = few.withColumn("_upto", upto).withColumn("_all", F.sum("_m").over(Window.partitionBy(*group)))

        def at(rank: Column) -> Column:
            return F.max(F.when((F.col("_upto") - F.col("_m") <= rank) & (rank < F.col("_upto")), F.col("_v")))

        median = (at(F.floor((F.col("_all") - 1) / 2)) + at(F.floor(F.col("_all") / 2))) / 2
        found.append(few.groupBy(*group).agg(F.sum("_d").alias("n_distinct"), median.alias("median_in_range")))
    if patterns:
        texts = F.array(*[F.struct(F.lit(len(ranges) + i).alias("_c"), F.col(f"_t_{i}").alias("_t")) for i in range(len(patterns))])
        long = df.select("_entity", "_load", F.explode(texts).alias("_x")).select("_entity", "_load", "_x.*").where(F.col("_t").isNotNull()).distinct()
        found.append(long.groupBy(*group).agg(F.count("*").alias("n_distinct"), F.lit(None).cast("double").alias("median_in_range")))
    return reduce(DataFrame.unionByName, found)


def _rank(value: str, cuts: str) -> str:
    """How many of a load's tenths a value is beyond."""
    return "coalesce(" + " + ".join(f"int({value} > {cuts}[{k}])" for k in range(9)) + ", 0)"


#: Bins of a column in a pair of loads: null, below and above the range, and the ranks among 18 tenths.
LEVELS = 22
#: Padded cells of the matrices of pairs that are fitted at once.
FITTED = 4_000_000


def _areas(score: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Areas under the curve, row by row, for weights of either label; ties count half. NaN where a label is absent."""
    order = np.argsort(np.round(score, 9), axis=1, kind="stable")
    s, ones, zeros = (np.take_along_axis(x, order, 1) for x in (np.round(score, 9), ones, zeros))
    n, at = s.shape[1], np.arange(s.shape[1])
    fresh = np.ones(s.shape, bool)
    fresh[:, 1:] = s[:, 1:] != s[:, :-1]
    first = np.maximum.accumulate(np.where(fresh, at, 0), axis=1)
    last = np.minimum.accumulate(np.where(np.roll(fresh, -1, 1) | (at == n - 1), at, n)[:, ::-1], axis=1)[:, ::-1]
    upto = np.cumsum(zeros, axis=1)
    below = np.take_along_axis(upto - zeros, first, 1) + np.take_along_axis(upto, last, 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (ones * below).sum(1) / 2 / (ones.sum(1) * zeros.sum(1))


def _newton(x: np.ndarray, label: np.ndarray, weight: np.ndarray, beta: np.ndarray, ridge: float, steps: int) -> np.ndarray:
    """Newton steps of weighted logistic regressions from where they stand, one for each matrix of ``x``."""
    penalty = np.full(x.shape[2], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip((x @ beta[:, :, None])[:, :, 0], -30, 30)))
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, :, None]).transpose(0, 2, 1) @ x + np.diag(penalty)
        slope = ((weight * (label - p))[:, None, :] @ x)[:, 0] - penalty * beta
        beta = beta + np.linalg.solve(hessian, slope[:, :, None])[:, :, 0]
    return beta


def _by_permutations(odds: np.ndarray, ones: np.ndarray, both: np.ndarray) -> float:
    """The normal quantile of the exact share of permutations of the labels with a smaller area under the curve."""
    _, where = np.unique(odds, return_inverse=True)
    ones, both = np.bincount(where, ones), np.bincount(where, both)
    n1, n = int(ones.sum()), int(both.sum())
    twice = 2 * np.cumsum(both) - both + 1
    # How many ways there are to choose k rows with twice the rank sum s, a group of ties after the other.
    ways = np.zeros((n1 + 1, n * (n + 1) + 1))
    ways[0, 0] = 1
    for size, rank in zip(both.astype(int), twice.astype(int)):
        new = np.zeros_like(ways)
        for k in range(min(size, n1) + 1):
            new[k:, k * rank :] += comb(int(size), k) * ways[: ways.shape[0] - k, : ways.shape[1] - k * rank]
        ways = new
    share = ways[n1, int((ones * twice).sum()) :].sum() / ways[n1].sum()
    return NormalDist().inv_cdf(min(max(1 - share, 1e-12), 1 - 1e-12))


def _alone(odds: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of counts by bin (last axis) of rows that the bins' odds weren't trained on: the area under the curve, and how many standard deviations it is above what labels dealt at random
    would give, with ties.

    Labels are exchangeable where both loads are drawn from one distribution, so the latter is standard normal then (for fewer than EXACT_ROWS rows by
    all permutations).
    """
    same, under = odds[..., :, None] == odds[..., None, :], odds[..., :, None] > odds[..., None, :]
    both = ones + zeros
    ties = (same * both[..., None, :]).sum(-1)
    below = (under * both[..., None, :]).sum(-1)
    n1, n0 = ones.sum(-1), zeros.sum(-1)
    n = n1 + n0
    with np.errstate(invalid="ignore", divide="ignore"):
        area = (ones * ((under * zeros[..., None, :]).sum(-1) + (same * zeros[..., None, :]).sum(-1) / 2)).sum(-1) / (n1 * n0)
        spread = n1 * n0 / 3 * (n + 1 - (both * (ties**2 - 1)).sum(-1) / (n * (n - 1)))
        beyond = np.where(spread > 0, ((ones * (2 * below + ties + 1)).sum(-1) - n1 * (n + 1)) / np.sqrt(spread), 0.0)
    for at in zip(*np.nonzero((n < EXACT_ROWS) & (n1 > 0) & (n0 > 0))):
        beyond[at] = _by_permutations(odds[at], ones[at], both[at])
    return area, beyond


def _features(cells: np.ndarray) -> np.ndarray:
    """Of the bins of each column: the rank and its square, and whether it is null, below or above the range; the constant first."""
    rank = np.where(cells > 2, (cells - 3) / (LEVELS - 4), 0.0)
    parts = np.stack([rank, rank**2, cells == 0, cells == 1, cells == 2], -1)
    return np.concatenate([np.ones((len(cells), 1)), parts.reshape(len(cells), -1)], 1)


def _discriminate(begins: np.ndarray, ends: np.ndarray, cells: np.ndarray, fold: np.ndarray, label: np.ndarray, weight: np.ndarray, ridge: float, steps: int) -> np.ndarray:
    """For each pair of loads (rows from ``begins`` up to ``ends``) and column: cross-fitted AUC with all columns, without the column, and with it alone; and the p-value of the last.

    Pairs of like sizes are fitted at once. Without a column the regression goes on from the one with all; alone, a column's bins have the odds of a logistic regression in closed form, with one row of
    each label added. The two folds' statistics depend on one another (each is trained on what the other is tested on), so their mean is taken for
    a standard normal variable, which it is if they are one and the same, and narrower than if not: the level holds in either case.
    """
    out = np.full((len(begins), cells.shape[1], 4), np.nan)
    sizes, x, columns = ends - begins, _features(cells), cells.shape[1]
    kind = np.ceil(np.log2(np.maximum(sizes, 16)) * 2).astype(int)
    normal = NormalDist()
    for k in np.unique(kind):
        members = np.flatnonzero(kind == k)
        step = max(1, FITTED // (int(sizes[members].max()) * x.shape[1] + 4 * columns * LEVELS**2))
        for some in (members[i : i + step] for i in range(0, len(members), step)):
            width = int(sizes[some].max())
            at = begins[some][:, None] + np.arange(width)
            inside = at < ends[some][:, None]
            at = np.where(inside, at, 0)
            y, w, f, xs, own = label[at], weight[at] * inside, fold[at], x[at], cells[at]
            pair = np.arange(len(some))[:, None, None]
            index = (((pair * 2 + f[:, :, None]) * 2 + y[:, :, None].astype(int)) * columns + np.arange(columns)) * LEVELS + own
            counts = np.bincount(index.ravel(), np.repeat(w.ravel(), columns), len(some) * 4 * columns * LEVELS).reshape(len(some), 2, 2, columns, LEVELS)
            areas, beyond = np.full((2, len(some), columns, 3), np.nan), np.full((2, len(some), columns), np.nan)
            fine = (counts[:, :, :, 0].sum(-1) > 0).all((1, 2))  # both labels in both folds
            for part in (0, 1):
                odds = np.log((counts[:, 1 - part, 1] + 1) / (counts[:, 1 - part, 0] + 1))
                areas[part, :, :, 2], beyond[part] = _alone(np.round(odds, 9), counts[:, part, 1], counts[:, part, 0])
                train, test = w * (f != part), w * (f == part)
                beta = _newton(xs, y, train, np.zeros((len(some), xs.shape[2])), ridge, steps)
                areas[part, :, :, 0] = _areas((xs @ beta[:, :, None])[:, :, 0], test * y, test * (1 - y))[:, None]
                for c in range(columns):
                    rest = np.delete(np.arange(xs.shape[2]), np.arange(1 + 5 * c, 6 + 5 * c))
                    less = xs[:, :, rest]
                    found = _newton(less, y, train, beta[:, rest], ridge, 2)
                    areas[part, :, c, 1] = _areas((less @ found[:, :, None])[:, :, 0], test * y, test * (1 - y))
            z = beyond.mean(0)
            p = np.array([1 - normal.cdf(v) for v in np.nan_to_num(z).ravel()]).reshape(z.shape)
            out[some] = np.where(fine[:, None, None], np.concatenate([areas.mean(0), p[:, :, None]], -1), np.nan)
    return out


def _two_sample(rows: DataFrame, ranges: dict[str, tuple[float, float]], ridge: float = 1.0, steps: int = 4) -> DataFrame:
    """Classifier two-sample test of each load against the load before.

    The features are the bins of each column, cut at the tenths of both loads, so a pair of loads reduces to
    counts of bin combinations: a bounded table whatever the size of the loads, aggregated before and after the shuffle. A load is aggregated once, for its pair
    with the load before and the one after it, by its ranks among the tenths of all three. On these counts of all rows the regressions are trained, each pair by its own task.
    """
    names = list(ranges)
    every = range(len(names))
    kinds = []
    for i, (lo, hi) in enumerate(ranges.values()):
        v = f"_v_{i}"
        # 0: null, 1 and 2: below and above the range; else the ranks among the tenths of this load, of the one before and of the one after, 3 + their sum being the bin in a pair.
        odd = f"case when {v} is null then 0 when {v} < {float(lo)!r}D then 1 when {v} > {float(hi)!r}D then 2 end"
        ranks = [f"if({v} between {float(lo)!r}D and {float(hi)!r}D, {_rank(v, q)}, 0)" for q in (f"_q_{i}", f"_p_{i}", f"_s_{i}")]
        kinds += [F.expr(f"cast({e} as tinyint) as {n}_{i}") for e, n in zip((odd, *ranks), ("_o", "_r", "_rp", "_rs"))]
    keys = ["_entity", "_load", "_fold", *(f"{n}_{i}" for i in every for n in ("_o", "_r", "_rp", "_rs"))]
    df = rows.where(F.col("_entity").isNotNull() & F.col("_load").isNotNull() & (F.col("_before") | F.col("_after"))).select("_entity", "_load", "_fold", "_before", "_after", *kinds)
    counts = df.groupBy(*keys, "_before", "_after").agg(F.count("*").alias("_n"))
    pair = [F.struct(((F.col("_load") if y else F.col("_load") + 1)).alias("_load"), F.lit(y).alias("_y"), *[F.coalesce(f"_o_{i}", F.col(f"_r_{i}") + F.col(f"{r}_{i}") + 3).cast("int").alias(f"_b_{i}") for i in every]) for y, r in ((1, "_rp"), (0, "_rs"))]
    both = F.array_compact(F.array(F.when(F.col("_before"), pair[0]), F.when(F.col("_after"), pair[1])))
    counts = counts.select("_entity", "_fold", "_n", F.explode(both).alias("_x")).select("_entity", "_x.*", "_fold", "_n")

    entity, load = (df.schema[c].dataType.simpleString() for c in ("_entity", "_load"))
    binned = [f"_b_{i}" for i in range(len(names))]
    columns = ["_entity", "_load", "column_name", "auc", "auc_without", "auc_alone", "p_value"]

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by pair, so that a pair's rows follow one another; those of the last pair of a batch wait for the next batch."""
        waiting: pd.DataFrame | None = None
        for pdf in _and_end(batches):
            rows = pdf if waiting is None else waiting if pdf is None else pd.concat([waiting, pdf], ignore_index=True)
            if rows is None or not len(rows):
                continue
            keys = rows[["_entity", "_load"]]
            begins = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy())
            ends = [*begins[1:], len(rows)]
            if pdf is not None:
                waiting, begins, ends = rows.iloc[begins[-1] :], begins[:-1], ends[:-1]
            cells, fold, label, weight = rows[binned].to_numpy(), rows["_fold"].to_numpy(), rows["_y"].to_numpy(float), rows["_n"].to_numpy(float)
            entities, loads = rows["_entity"].to_list(), rows["_load"].to_list()
            if not len(begins):
                continue
            found = _discriminate(np.asarray(begins), np.asarray(ends), cells, fold, label, weight, ridge, steps)
            out = [(entities[i], loads[i], name, *found[k, c]) for k, i in enumerate(begins) for c, name in enumerate(names)]
            yield pd.DataFrame(out, columns=columns)

    schema = f"_entity {entity}, _load {load}, column_name string, auc double, auc_without double, auc_alone double, p_value double"
    return counts.repartition("_entity", "_load").sortWithinPartitions("_entity", "_load", *binned, "_fold", "_y").mapInPandas(train, schema)


def _and_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def profile_loads(df: DataFrame, entity: str, load: str, row_id: str, ranges: dict[str, tuple[float, float]], patterns: dict[str, str]) -> DataFrame:
    """Profile columns of each load of each entity, and compare each load with the load numbered one less.

    ``ranges`` has the valid range of each numeric column, ``patterns`` a regular expression for each text column. One row for
    each entity, load and column: ``kind`` (``number`` or ``text``), ``n_rows``, ``n_null`` (NaN included), ``null_rate``, ``n_distinct``, ``min_value``, ``max_value``,
    ``n_out_of_range``, ``n_pattern`` (texts that don't match), ``median_in_range`` (exact), the same of the load before (``prev_...``; null
    if there is none). Of the classifier two-sample test against the load before: ``auc`` (both loads told apart by all numeric columns, cross-fitted), ``auc_without`` the
    column (ablation), ``auc_alone``, ``p_value`` of the latter; ``changed``: the test sees a change of the column's distribution (nulls and values out of range included) at LEVEL; and
    ``undecided``: the bins of the test, the middle one of which holds the median, leave room for one median twice the other.

    Nothing is sampled: base aggregates are exact, medians included, and the classifier is trained on counts of all rows. A pair of loads is fitted by one task, on its table of
    counts, whose size is bounded by the bins.

    Defined cases: -0.0 counts as 0.0; infinite values are out of range; a null entity or load number is a group of its own
    without a load before; a column that is null throughout has null measures; AUCs, ``p_value`` and ``changed`` are null where a fold has one load only; an empty
    table gives an empty profile; repeated rows count; other columns are ignored, whatever their names.
    """
    names = [*ranges, *patterns]
    numbers, texts = range(len(ranges)), range(len(patterns))
    of_row = F.xxhash64(df[row_id])
    src = df.select(
        df[entity].alias("_entity"), df[load].alias("_load"), (F.pmod(of_row, F.lit(2))).cast("tinyint").alias("_fold"), F.pmod(F.shiftright(of_row, 1), F.lit(SALTS)).cast("int").alias("_salt"),
        *[_clean(df[c]).alias(f"_v_{i}") for i, c in enumerate(ranges)],
        *[df[c].cast("string").alias(f"_t_{i}") for i, c in enumerate(patterns)],
    )
    loads = cut(_loads(src, ranges, patterns))  # one row for each load
    pair = ["_entity", "_load"]
    cuts = loads.select(*pair, *[f"_q_{i}" for i in numbers])
    before = cuts.select("_entity", (F.col("_load") + 1).alias("_load"), F.lit(True).alias("_before"), *[F.col(f"_q_{i}").alias(f"_p_{i}") for i in numbers])
    after = cuts.select("_entity", (F.col("_load") - 1).alias("_load"), F.lit(True).alias("_after"), *[F.col(f"_q_{i}").alias(f"_s_{i}") for i in numbers])
    beside = cuts.join(before, pair, "left").join(after, pair, "left").withColumn("_before", F.coalesce("_before", F.lit(False))).withColumn("_after", F.coalesce("_after", F.lit(False)))
    rows = _with_loads(src.drop(*[f"_t_{i}" for i in texts]), beside, ["_before", "_after", *[f"{n}_{i}" for i in numbers for n in ("_q", "_p", "_s")]])
    tested = _two_sample(rows, ranges) if ranges else None

    none, zero = F.lit(None).cast("double"), F.lit(0).cast("long")
    cells = [
        F.struct(F.lit(i).alias("_c"), F.lit(names[i]).alias("column_name"), F.lit("number").alias("kind"), (F.col("_n") - F.col(f"_k_{i}")).alias("n_null"), F.col(f"_min_{i}").alias("min_value"), F.col(f"_max_{i}").alias("max_value"),
                 F.col(f"_out_{i}").alias("n_out_of_range"), zero.alias("n_pattern"), F.get(f"_q_{i}", F.lit(3)).alias("_low"), F.get(f"_q_{i}", F.lit(5)).alias("_high"))
        for i in numbers
    ] + [
        F.struct(F.lit(len(ranges) + i).alias("_c"), F.lit(names[len(ranges) + i]).alias("column_name"), F.lit("text").alias("kind"), (F.col("_n") - F.col(f"_tk_{i}")).alias("n_null"), none.alias("min_value"), none.alias("max_value"),
                 zero.alias("n_out_of_range"), F.col(f"_off_{i}").alias("n_pattern"), none.alias("_low"), none.alias("_high"))
        for i in texts
    ]
    base = loads.select(*pair, F.col("_n").alias("n_rows"), F.explode(F.array(*cells)).alias("_x")).select(*pair, "n_rows", "_x.*")
    base = _joined(base, _distinct_and_median(rows, src, ranges, patterns), [*pair, "_c"], "left").withColumn("n_distinct", F.coalesce("n_distinct", zero)).drop("_c")
    base = cut(base)  # a row for each load and column, read twice below
    group = [*pair, "column_name"]
    measures = ["n_rows", "n_null", "n_distinct", "median_in_range"]
    prev = base.select("_entity", (F.col("_load") + 1).alias("_load"), "column_name", *[F.col(m).alias(f"prev_{m}") for m in measures], F.col("_low").alias("_prev_low"), F.col("_high").alias("_prev_high"))
    out = base.join(prev, group, "left")
    if tested is not None:
        out = out.join(tested, group, "left")
    else:
        out = out.select("*", *[none.alias(n) for n in ("auc", "auc_without", "auc_alone", "p_value")])
    room = (F.col("_high") > 2 * F.col("_prev_low")) | (F.col("_prev_high") > 2 * F.col("_low"))
    out = out.withColumn("p_value", F.nanvl("p_value", none))
    return out.select(
        F.col("_entity").alias(entity), F.col("_load").alias(load), "column_name", "kind", "n_rows", "n_null", (F.col("n_null") / F.col("n_rows")).alias("null_rate"),
        "n_distinct", "min_value", "max_value", "n_out_of_range", "n_pattern", "median_in_range",
        *[f"prev_{m}" for m in measures], *[F.nanvl(F.col(c), none).alias(c) for c in ("auc", "auc_without", "auc_alone")], "p_value", (F.col("p_value") < LEVEL).alias("changed"), room.alias("undecided"),
    )


def load_findings(profile: DataFrame, entity: str, load: str) -> DataFrame:
    """The findings of a profile: (entity, load, ``column_name``, ``finding``), and beside them the two-sample test's ``auc``, ``auc_without``, ``auc_alone`` and ``p_value``.

    ``range`` and ``pattern``: values out of the range, texts against the pattern (null texts aren't). For numbers, against the load before: ``null_rate`` (differs by more than
    0.25), ``distinct`` (less than a quarter as many) and ``shift``: one exact median is more than twice the other, however few values a load has inside the range.

    A ``shift`` is a candidate of the two-sample test first: a column that the test calls changed at its level, or for which its bins can't rule a doubling out (``undecided``); the exact medians
    check the candidates. The median of a load lies between its fourth and sixth tenth, which are cuts of the test's bins, so a column that is refused has no such shift: the
    candidates lose none.
    """
    c = F.col
    candidate = F.coalesce(c("changed"), F.lit(False)) | c("undecided")
    moved = candidate & ((c("median_in_range") > 2 * c("prev_median_in_range")) | (c("prev_median_in_range") > 2 * c("median_in_range")))
    rate, was = c("n_null") / c("n_rows"), c("prev_n_null") / c("prev_n_rows")
    tests = {
        "range": c("n_out_of_range") > 0,
        "pattern": c("n_pattern") > 0,
        "null_rate": F.abs(rate - was) > 0.25,
        "distinct": 4 * c("n_distinct") < c("prev_n_distinct"),
        "shift": moved,
    }
    found = F.array_compact(F.array(*[F.when(t & (F.lit(k == "pattern") | (c("kind") == "number")), k) for k, t in tests.items()]))
    return profile.select(entity, load, "column_name", F.explode(found).alias("finding"), "auc", "auc_without", "auc_alone", "p_value")


def load_changes(profile: DataFrame, entity: str, load: str) -> DataFrame:
    """What the classifier finds by itself: the columns of loads whose distribution changed since the load before, at LEVEL (a false one in a hundred comparisons of loads without a change), the clearest first by ``p_value``."""
    gain = (F.col("auc") - F.col("auc_without")).alias("gain")
    return profile.where("changed").select(entity, load, "column_name", "auc", "auc_alone", gain, "p_value", "median_in_range", "prev_median_in_range", "null_rate", (F.col("prev_n_null") / F.col("prev_n_rows")).alias("prev_null_rate"))
