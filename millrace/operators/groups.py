"""Folding and grouping by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.rows import in_order, row_struct

#: Folds that are native aggregates, with partial sums before the shuffle.
NATIVE: dict[str, Callable[[Column], Column]] = {
    "+": F.sum,
    "*": F.product,
    "max": F.max,
    "min": F.min,
    "&&": F.bool_and,
    "||": F.bool_or,
    "land": F.bit_and,
    "lor": F.bit_or,
    "first": F.first,
}
#: Parts of a group that are folded apart before their results are.
PARTS = 64
#: Rows are folded in runs of 4,096 neighbours (as bits), then the results of all runs of a task.
RUNS = (12, 33)


def fold(df: DataFrame, key: Column, value: Column, how: str | Callable[[Column, Column], Column], parts: int = PARTS) -> DataFrame:
    """Fold the values of each key: columns ``key`` and ``value``. A missing key is a key.

    ``how`` is the name of a native fold, or a function of two columns that is associative and commutative. Such a function is applied within ``parts`` parts of each
    key first, then over their results, so a key with a third of all rows is spread over as many tasks. Within a part the values of neighbouring rows are folded, then
    the results of a task's runs (RUNS), then those of tasks, so no list is longer than 4,096 values, a task's rows / 4,096, or the tasks of the input. Two shuffles in all: of the
    rows' keys and values, and of one result for each key and part.
    """
    rows = df.select(key.alias("key"), value.alias("value"))
    if isinstance(how, str):
        agg = _missing_is_greatest(how)
        return rows.groupBy("key").agg(agg(F.col("value")).alias("value"))

    def folded(grouped: DataFrame, *by: str, also: str | None = None) -> DataFrame:
        more = [F.min(also).alias(also)] if also else []
        listed = grouped.groupBy(*by).agg(F.collect_list(F.struct("value")).alias("__l"), *more)
        rest = F.slice("__l", 2, F.size("__l"))
        out = F.aggregate(F.transform(rest, lambda s: s["value"]), F.get("__l", F.lit(0))["value"], how)
        return listed.select(*by, out.alias("value"), *([also] if also else []))

    run = F.shiftright("__at", RUNS[0])
    out = rows.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.pmod(F.xxhash64(run), F.lit(parts))).repartition("key", "__part")
    for shift in RUNS:
        out = folded(out.withColumn("__run", F.shiftright("__at", shift)), "key", "__part", "__run", also="__at").drop("__run")
    return folded(folded(out, "key", "__part"), "key")


def _missing_is_greatest(how: str) -> Callable[[Column], Column]:
    if how == "max":
        return lambda v: F.when(F.count_if(v.isNull()) == 0, F.max(v))
    return NATIVE[how]


def folded_where(how: str, value: Column, where: Column) -> Column:
    """A native fold of the values for which a condition holds, as an aggregate of all rows."""
    own = F.when(where, value)
    if how == "max":
        return F.when(F.count_if(where & value.isNull()) == 0, F.max(own))
    return NATIVE[how](own) if how != "first" else F.first(own, ignorenulls=True)


def group_rows(df: DataFrame, key: Column, value: Column | None = None) -> DataFrame:
    """``key`` and ``value``, the list of the key's rows (or values) in the order of the table.

    The list of a key is one value of one row; aggregate instead (:func:`fold`, or the language's ``cogroup | map``, which does) where only a count or a sum of it is wanted.
    """
    rows = in_order(df.select(key.alias("key"), (row_struct(df) if value is None else value).alias("__v")))
    listed = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("__row", F.col("__v")))).alias("__l"))
    return listed.select("key", F.transform("__l", lambda s: s["__v"]).alias("value"))


def group_aggregate(df: DataFrame, key: Column, aggregates: dict[str, Column]) -> DataFrame:
    """``key`` and aggregates of each group, with partial aggregation before the shuffle."""
    return df.groupBy(key.alias("key")).agg(*[a.alias(n) for n, a in aggregates.items()])
