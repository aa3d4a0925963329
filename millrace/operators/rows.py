"""Projection, selection, order and row access. A table of plain values is a DataFrame whose only column is ``_``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.nulls import ascending
from millrace.session import cut

VALUE = "_"


def map_rows(df: DataFrame, *outputs: Column, where: Column | None = None) -> DataFrame:
    """Filter, then give each output of each row, row by row. Outputs that are structs become the columns; others the column ``_``.

    Several outputs must have one type (the language unites them). There is no shuffle; filter and projection reach the scan.
    """
    src = df if where is None else df.where(where)
    if len(outputs) == 1:
        out = src.select(outputs[0].alias(VALUE))
    else:
        out = src.select(F.explode(F.array(*outputs)).alias(VALUE))
    return expand(out)


def expand(df: DataFrame) -> DataFrame:
    """A single struct column ``_`` as columns of its own."""
    kind = df.schema[0].dataType
    return df.select(f"{VALUE}.*") if kind.typeName() == "struct" and df.columns == [VALUE] else df


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first rows in the order of the table. A limit right after a sort runs as a top-n, without a full sort."""
    return df.limit(n)


def pick(df: DataFrame, where: Column) -> DataFrame:
    """The first row for which the condition holds, or no row."""
    return df.where(where).limit(1)


def sort_rows(df: DataFrame, *keys: Column) -> DataFrame:
    """Sort by columns (ascending, missing last) or by orders such as :func:`millrace.functions.nulls.descending` gives."""
    return df.orderBy(*[k if _is_order(k) else ascending(k) for k in keys])


def min_rows(df: DataFrame, n: int, *keys: Column) -> DataFrame:
    """The n smallest rows, all if n is negative: a top-n of each partition, merged."""
    out = sort_rows(df, *keys)
    return out if n < 0 else out.limit(n)


def _is_order(k: Column) -> bool:
    text = str(k)
    return " ASC NULLS " in text or " DESC NULLS " in text


#: Nodes of plans that give the same rows in the same partitions each time, and cost no more than reading.
_SCANS = {"Project", "Filter", "SubqueryAlias", "View"}


def is_scan(df: DataFrame) -> bool:
    """Whether a table is only read, projected and filtered, by built-in functions."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in _SCANS:
        if "monotonically_increasing_id" in plan.simpleString(10_000) or not plan.deterministic():
            return False
        plan = plan.children().head()
    return plan.children().isEmpty()


def row_struct(df: DataFrame) -> Column:
    """A row as one value."""
    return F.col(VALUE) if df.columns == [VALUE] else F.struct(*[F.col(f"`{c}`") for c in df.columns])


def in_order(df: DataFrame, name: str = "__row") -> DataFrame:
    """Number the rows in the order of the table, with gaps between partitions. Costs no shuffle."""
    return df.withColumn(name, F.monotonically_increasing_id())


def dense_order(df: DataFrame, name: str = "__row") -> DataFrame:
    """Number the rows in the order of the table, without gaps: one pass more, which counts the rows of each partition.

    Both passes have to see the same partitions, so a table that is more than a scan is checkpointed first.
    """
    numbered = in_order(df if is_scan(df) else cut(df), name)
    part = F.shiftright(name, 33)
    sizes = {r["p"]: r["n"] for r in numbered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    upto, offsets = 0, []
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(upto)
        upto += sizes.get(p, 0)
    base = F.get(F.lit(offsets) if offsets else F.array(F.lit(0)), part.cast("int"))
    return numbered.withColumn(name, base.cast("long") + F.col(name).bitwiseAND(F.lit((1 << 33) - 1)))
