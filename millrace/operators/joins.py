"""Joins of up to four tables in which a missing key is a value."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.rows import VALUE, is_scan

MOST_TABLES = 4
#: How a comparison joins: rows without a partner are kept on the right-hand side's behalf, and so on.
KINDS = {"==": "inner", "==?": "left", "?==": "right", "?==?": "full"}


@dataclass(frozen=True)
class Match:
    """``left.left_key op right.right_key``, where op is one of KINDS."""

    left: str
    left_key: str
    op: str
    right: str
    right_key: str


def prefixed(name: str, df: DataFrame) -> DataFrame:
    """Columns named ``table_column``; a table of plain values has the column ``table``."""
    return df.select(*[F.col(f"`{c}`").alias(name if c == VALUE else f"{name}_{c}") for c in df.columns])


def _column(table: str, key: str) -> Column:
    return F.col(f"`{table if key == VALUE else f'{table}_{key}'}`")


def join_two(left: DataFrame, right: DataFrame, x: Column, y: Column, op: str, null_extend: bool = False, no_nulls: bool = False) -> DataFrame:
    """Join on two keys.

    ``==``: equal keys, missing ones equal to each other. ``==?``: rows on the left whose key isn't missing, with their partners if any; ``?==`` is its
    mirror. ``?==?``: all rows of both sides, missing keys equal to each other. ``null_extend``: what ``==`` keeps is left to a condition that is applied when all tables
    are joined: all rows of both sides come out here. ``no_nulls``: no key is missing.

    The keys of all four are keys of a hash or sort-merge join; Spark broadcasts a side below its measured limit and splits skewed keys.
    """
    kind = KINDS[op]
    if kind == "inner":
        if null_extend:
            return left.join(right, x.eqNullSafe(y), "full")
        return left.join(right, x == y if no_nulls else x.eqNullSafe(y), "inner")
    if kind == "left":
        return left.where(x.isNotNull()).join(right, x == y, "left")
    if kind == "right":
        return left.join(right.where(y.isNotNull()), x == y, "right")
    return left.join(right, x.eqNullSafe(y), "full")


def null_keys(tables: dict[str, DataFrame], matches: list[Match]) -> bool:
    """Whether a key of an inner match may be missing. Tables that are no more than a scan are asked, all in one job, whose filter files answer from their
    statistics; of others, which would have to be computed for it, it is assumed."""
    asked: list[DataFrame] = []
    for name, df in tables.items():
        if df.isStreaming:
            continue  # has no answer yet
        keys = {k for m in matches if m.op == "==" for t, k in ((m.left, m.left_key), (m.right, m.right_key)) if t == name}
        nullable = [k for k in sorted(keys) if df.schema[k].nullable]
        if not nullable:
            continue
        if not is_scan(df):
            return True
        missing = reduce(Column.__or__, [F.col(f"`{k}`").isNull() for k in nullable])
        asked.append(df.where(missing).limit(1).select(F.lit(True)))
    return bool(asked) and bool(reduce(DataFrame.unionByName, asked).take(1))


def join_tables(
    tables: dict[str, DataFrame], matches: list[Match], where: Callable[[], Column] | Column | None = None, null_extend: bool = False
) -> DataFrame:
    """Join tables by ``matches``, in their order; then filter by ``where``, the whole condition over the columns ``table_column``.

    A match between tables that are joined already is left to ``where``; tables that no match connects are joined as a cross product, under ``where``
    as its condition where nothing else joins them.

    ``null_extend`` (a quirk that the language keeps): a row with a missing key whose partner table has none comes out of an inner match too, the partner being
    missing. Where keys are missing or may be (:func:`null_keys`), inner matches are full joins for that, and the condition, by which a missing value equals
    a missing value, keeps what belongs to the result; each table is still read once. Else they are plain inner joins.
    """
    if not 1 <= len(tables) <= MOST_TABLES:
        raise ValueError(f"join takes up to {MOST_TABLES} tables")
    inner = [m for m in matches if m.op == "=="]
    nulls = bool(inner) and null_keys(tables, matches)
    extend = null_extend and nulls
    parts = {n: (frozenset([n]), prefixed(n, t)) for n, t in tables.items()}
    for m in matches:
        (of_x, x), (of_y, y) = parts[m.left], parts[m.right]
        if of_x == of_y:
            continue
        both = (of_x | of_y, join_two(x, y, _column(m.left, m.left_key), _column(m.right, m.right_key), m.op, extend, not nulls and len(inner) == len(matches)))
        for n in both[0]:
            parts[n] = both
    condition = where() if callable(where) else where
    if condition is None and extend:
        condition = reduce(Column.__and__, [_column(m.left, m.left_key).eqNullSafe(_column(m.right, m.right_key)) for m in inner])
    apart: list[tuple[frozenset, DataFrame]] = []
    for part in parts.values():
        if part[0] not in [p[0] for p in apart]:
            apart.append(part)
    out = apart[0][1]
    for i, (_, df) in enumerate(apart[1:], 2):
        out = out.join(df, condition, "inner") if i == len(apart) and condition is not None else out.crossJoin(df)
    if condition is not None:
        out = out.where(condition)
    order = [c for n, t in tables.items() for c in prefixed(n, t).columns]
    return out.select(*[F.col(f"`{c}`") for c in order])


def anti_join(left: DataFrame, right: DataFrame, x: Column, y: Column) -> DataFrame:
    """Rows on the left without a partner. As in a left join, rows whose key is missing don't count."""
    return left.where(x.isNotNull()).join(right, x == y, "left_anti")


def semi_join(left: DataFrame, right: DataFrame, x: Column, y: Column) -> DataFrame:
    """Rows on the left with a partner, once each; missing keys are equal to each other."""
    return left.join(right, x.eqNullSafe(y), "left_semi")


def without_partner(tables: dict[str, DataFrame], m: Match) -> DataFrame:
    """What :func:`join_tables` gives for a left (or right) join of two tables whose other key is missing: an anti-join, and missing values for the other side."""
    keep, lose = (m.left, m.right) if m.op == "==?" else (m.right, m.left)
    keys = {m.left: m.left_key, m.right: m.right_key}
    out = anti_join(prefixed(keep, tables[keep]), prefixed(lose, tables[lose]), _column(keep, keys[keep]), _column(lose, keys[lose]))
    absent = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in prefixed(lose, tables[lose]).schema.fields}
    return out.select(*[absent.get(c, F.col(f"`{c}`")) for n, t in tables.items() for c in prefixed(n, t).columns])
