"""Unions, and reshaping between rows and columns. Columns that depend on the data take a pass over their names first."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.rows import VALUE, expand

#: New columns a table may get from its data.
MOST_COLUMNS = 10_000


def concat(*tables: DataFrame) -> DataFrame:
    """All rows of the tables in turn; a column that a table lacks is missing in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def flatten(*tables: DataFrame) -> DataFrame:
    """The rows of the tables in the cells of one-column tables."""
    out = []
    for df in tables:
        if len(df.columns) != 1:
            raise ValueError("flatten takes tables of one column")
        out.append(expand(df.select(F.explode(F.col(f"`{df.columns[0]}`")).alias(VALUE))))
    return concat(*out)


def _common(schema: T.StructType, columns: list[str]) -> str:
    kinds = {schema[c].dataType.simpleString() for c in columns}
    if len(kinds) == 1:
        return kinds.pop()
    return "double" if kinds <= {"int", "bigint", "float", "double", "smallint", "tinyint"} else "string"


def gather(df: DataFrame, columns: list[str], key: str, value: str) -> DataFrame:
    """One row for each of the columns: the other columns, the column's name and its value, missing ones included."""
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise ValueError(f"no such columns: {', '.join(lost)}")
    rest = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    kind = _common(df.schema, columns)
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").cast(kind).alias("v")) for c in columns])
    return df.select(*rest, F.explode(pairs).alias("__p")).select(*rest, F.col("__p.k").alias(key), F.col("__p.v").alias(value))


def _names(df: DataFrame, name: Column) -> list[str]:
    found = df.select(name.alias("n")).where("n is not null").distinct().limit(MOST_COLUMNS + 1).collect()
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} new columns")
    return sorted(r["n"] for r in found)


def spread(df: DataFrame, key: str, value: str, names: list[str] | None = None) -> DataFrame:
    """Row by row: the other columns, and the value in a column named by the key. ``names`` saves the pass that finds them."""
    text = F.col(f"`{key}`").cast("string")
    names = _names(df, text) if names is None else names
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (key, value)]
    return df.select(*rest, *[F.when(text == n, F.col(f"`{value}`")).alias(n) for n in names])


def collapse_cell(rows: Column, kind: T.StructType, columns: list[str]) -> tuple[Column, T.StructType]:
    """As :func:`millrace.operators.collapse.collapse`, of a table in a cell."""
    rest = [f for f in kind.fields if f.name not in columns]
    out = T.StructType([*rest, *(kind[c] for c in columns)])

    def step(done: Column, row: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        apart = F.size(done) == 0
        for f in rest:
            apart = apart | ~last[f.name].eqNullSafe(row[f.name])
        for c in columns:
            apart = apart | (last[c].isNotNull() & row[c].isNotNull())
        own = F.struct(*[row[f.name].alias(f.name) for f in out.fields])
        merged = F.struct(*[(F.coalesce(last[f.name], row[f.name]) if f.name in columns else last[f.name]).alias(f.name) for f in out.fields])
        return F.when(apart, F.concat(done, F.array(own))).otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(merged)))

    return F.aggregate(rows, F.array().cast(T.ArrayType(out)), step), out


def gather_cell(rows: Column, kind: T.StructType, columns: list[str], key: str, value: str) -> tuple[Column, T.StructType]:
    """As :func:`gather`, of a table in a cell."""
    lost = [c for c in columns if c not in kind.names]
    if lost:
        raise ValueError(f"no such columns: {', '.join(lost)}")
    rest = [f for f in kind.fields if f.name not in columns]
    of = _common(kind, columns)

    def pairs(x: Column) -> Column:
        return F.array(*[F.struct(*[x[f.name].alias(f.name) for f in rest], F.lit(c).alias(key), x[c].cast(of).alias(value)) for c in columns])

    return F.flatten(F.transform(rows, pairs)), T.StructType([*rest, T.StructField(key, T.StringType()), T.StructField(value, T._parse_datatype_string(of))])


def transpose(df: DataFrame, key: Column, cells: str, entry: Callable[[Column], tuple[Column, Column]], names: list[str] | None = None) -> DataFrame:
    """Row by row: the fields of ``key``, and a column for each row of the table in the cell ``cells``.

    ``entry`` gives the name and the value of a row of the cell. The only pass besides the projection is the one that finds the names.
    """
    def pair(row: Column) -> Column:
        name, value = entry(row)
        return F.struct(name.alias("n"), value.alias("v"))

    entries = F.transform(F.coalesce(F.col(f"`{cells}`"), F.array()), pair)
    rows = df.select(key.alias("__k"), entries.alias("__p"))
    if names is None:
        names = _names(rows.select(F.explode("__p").alias("e")), F.col("e.n"))

    def of(name: str) -> Column:
        return F.get(F.filter("__p", lambda e: e["n"] == name), F.lit(0))["v"].alias(name)

    return rows.select("__k.*", *map(of, names))
