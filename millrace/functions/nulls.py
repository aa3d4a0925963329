"""Equality and order in which a missing value (null) is a value: equal to itself and greater than all others.

Each function gives a column that is never null. The ``where_...`` forms are for filters and join conditions, where null means false:
they hold for the same rows, and Spark pushes them into Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def eq(x: Column, y: Column) -> Column:
    return x.eqNullSafe(y)


def ne(x: Column, y: Column) -> Column:
    return ~x.eqNullSafe(y)


def gt(x: Column, y: Column) -> Column:
    return F.coalesce(x > y, x.isNull() & y.isNotNull())


def ge(x: Column, y: Column) -> Column:
    return F.coalesce(x >= y, x.isNull())


def where_gt(x: Column, y: Column, y_is_value: bool = False) -> Column:
    """``gt`` for a filter. ``y_is_value``: y is known not to be null."""
    return (x > y) | (x.isNull() if y_is_value else x.isNull() & y.isNotNull())


def where_ge(x: Column, y: Column) -> Column:
    return (x >= y) | x.isNull()


def eq_or_right_null(x: Column, y: Column) -> Column:
    """The condition of a left join: x is a value, and y is missing or equal."""
    return F.coalesce(x == y, x.isNotNull() & y.isNull())


def eq_or_left_null(x: Column, y: Column) -> Column:
    """The condition of a right join."""
    return eq_or_right_null(y, x)


def eq_or_either_null(x: Column, y: Column) -> Column:
    """The condition of a full join."""
    return F.coalesce(x == y, F.lit(True))


def greatest(*xs: Column) -> Column:
    """The greatest value; missing if any is missing."""
    missing = xs[0].isNull()
    for x in xs[1:]:
        missing = missing | x.isNull()
    return xs[0] if len(xs) == 1 else F.when(~missing, F.greatest(*xs))


def least(*xs: Column) -> Column:
    """The least value; missing only if all are."""
    return xs[0] if len(xs) == 1 else F.least(*xs)


def ascending(x: Column) -> Column:
    return x.asc_nulls_last()


def descending(x: Column) -> Column:
    return x.desc_nulls_first()
