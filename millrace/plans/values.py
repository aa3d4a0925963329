"""What expressions of the language stand for while a plan is built: columns, rows, tables and functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.rows import VALUE

if TYPE_CHECKING:
    from millrace.plans.syntax import Node

DURATION = T.DayTimeIntervalType()


class EvalProblem(ValueError):
    """An expression has no meaning."""


class NotColumnar(Exception):
    """An expression of a row needs a job of its own, such as opening a file that the row names."""


@dataclass
class Cell:
    """A column and its type. ``free``: it depends on no row. ``where``: the same condition for filters. ``down``: what is sorted in descending order."""

    col: Column
    type: T.DataType
    free: bool = False
    where: Column | None = None
    down: Cell | None = None
    value: Any = None  # of a literal
    literal: bool = False


@dataclass
class Row:
    """A struct whose fields are known one by one."""

    fields: dict[str, Any]


@dataclass
class Table:
    """A DataFrame; ``cell`` is the same table as an array, where it was written as a literal."""

    make: Callable[[], DataFrame]
    cell: Cell | None = None
    attrs: dict[str, str] = field(default_factory=dict)
    group: tuple[DataFrame, Cell, Any] | None = None  # of a table of groups: its rows before grouping, key and value
    _df: DataFrame | None = None

    @property
    def df(self) -> DataFrame:
        if self._df is None:
            self._df = self.make()
        return self._df


def table_of(df: DataFrame, **more: Any) -> Table:
    return Table(lambda: df, _df=df, **more)


@dataclass
class Tables:
    """A table of tables, none of which is in a cell."""

    items: list[Any]


@dataclass
class Function:
    params: tuple[str, ...]
    body: Node
    scope: dict[str, Any]


@dataclass
class Builtin:
    name: str


@dataclass
class GroupOf:
    """The table of a group's rows, of which only aggregates have been asked for so far: ``item`` is what a row of it is, ``where`` which rows are in it, ``order`` how it is sorted."""

    rows: Table
    value: Any
    wanted: dict[str, Column]
    where: Column | None = None
    order: list[Column] | None = None

    @property
    def item(self) -> Any:
        return row_of(self.rows.df) if self.value is None else self.value

    def holds(self, more: Column | None = None) -> Column:
        """Whether a row is in the table; never null."""
        parts = [F.coalesce(c, F.lit(False)) for c in (self.where, more) if c is not None]
        return parts[0] & parts[1] if len(parts) == 2 else parts[0] if parts else F.lit(True)

    def aggregate(self, col: Column, kind: T.DataType) -> Cell:
        name = f"__agg{len(self.wanted)}"
        self.wanted[name] = col
        return Cell(F.col(name), kind)


class GroupNeeded(Exception):
    """The rows of a group are needed as a table."""


# ---------------------------------------------------------------- literals


def type_of(value: Any) -> T.DataType:
    if isinstance(value, bool):
        return T.BooleanType()
    for python, kind in ((int, T.LongType()), (float, T.DoubleType()), (str, T.StringType()), (datetime, T.TimestampType()), (date, T.DateType()), (timedelta, DURATION)):
        if isinstance(value, python):
            return kind
    return T.NullType()


def literal(value: Any, kind: T.DataType | None = None) -> Any:
    """A Python value as a cell or row."""
    kind = type_of(value) if kind is None else kind
    if isinstance(kind, T.StructType) and value is not None:
        return Row({f.name: literal(value[f.name], f.dataType) for f in kind.fields})
    if value is None:
        return Cell(F.lit(None).cast(kind) if not isinstance(kind, T.NullType) else F.lit(None), kind, free=True, value=None, literal=True)
    if isinstance(kind, T.ArrayType):
        items = [to_cell(literal(x, kind.elementType)).col for x in value]
        return Cell(F.array(*items).cast(kind) if items else F.array().cast(kind), kind, free=True)
    return Cell(F.lit(value).cast(kind) if not isinstance(kind, T.StringType) else F.lit(value), kind, free=True, value=value, literal=True)


# ---------------------------------------------------------------- rows and cells


def fields_of(v: Any) -> dict[str, Any] | None:
    """The fields of a struct, or null if it isn't one."""
    if isinstance(v, Row):
        return v.fields
    if isinstance(v, Cell) and isinstance(v.type, T.StructType):
        return {f.name: Cell(v.col.getField(f.name), f.dataType, v.free) for f in v.type.fields}
    return None


def row_of(df: DataFrame) -> Any:
    """The row of a table as a value."""
    if df.columns == [VALUE]:
        return Cell(F.col(VALUE), df.schema[0].dataType)
    return Row({f.name: Cell(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields})


def to_cell(v: Any) -> Cell:
    """A value as one column."""
    if isinstance(v, Cell):
        return v
    if isinstance(v, Row):
        cells = {n: to_cell(x) for n, x in v.fields.items()}
        if not cells:
            raise EvalProblem("an empty struct")
        kind = T.StructType([T.StructField(n, c.type) for n, c in cells.items()])
        return Cell(F.struct(*[c.col.alias(n) for n, c in cells.items()]), kind, all(c.free for c in cells.values()))
    if isinstance(v, Table) and v.cell is not None:
        return v.cell
    if isinstance(v, Tables):
        cells = [to_cell(x) for x in v.items]
        kind = common_type([c.type for c in cells])
        return Cell(F.array(*[cast_to(c, kind) for c in cells]), T.ArrayType(kind), all(c.free for c in cells))
    if isinstance(v, GroupOf):
        raise GroupNeeded
    raise EvalProblem(f"a {kind_name(v)} can't be a value in a row")


def kind_name(v: Any) -> str:
    if isinstance(v, Cell):
        return {"bigint": "int", "double": "float", "boolean": "bool", "void": "null"}.get(v.type.simpleString(), v.type.typeName())
    return {Row: "struct", Table: "table", Tables: "table", GroupOf: "table", Function: "function", Builtin: "function"}.get(type(v), type(v).__name__)


def common_type(kinds: list[T.DataType]) -> T.DataType:
    """The type that all fit: ints with floats are floats, structs have all fields, in order of first appearance."""
    kinds = [k for k in kinds if not isinstance(k, T.NullType)]
    if not kinds:
        return T.NullType()
    if all(k == kinds[0] for k in kinds):
        return kinds[0]
    if all(isinstance(k, T.NumericType) for k in kinds):
        return T.LongType() if all(isinstance(k, T.IntegralType) for k in kinds) else T.DoubleType()
    if all(isinstance(k, T.ArrayType) for k in kinds):
        return T.ArrayType(common_type([k.elementType for k in kinds]))
    if all(isinstance(k, T.StructType) for k in kinds):
        names = dict.fromkeys(f.name for k in kinds for f in k.fields)
        return T.StructType([T.StructField(n, common_type([k[n].dataType for k in kinds if n in k.names])) for n in names])
    raise EvalProblem("types don't agree: " + ", ".join(sorted({k.simpleString() for k in kinds})))


def cast_to(c: Cell, kind: T.DataType) -> Column:
    """The column as ``kind``, which fits it; fields that it lacks are missing."""
    if c.type == kind or isinstance(kind, T.NullType):
        return c.col
    if isinstance(c.type, T.NullType):
        return F.lit(None).cast(kind)
    if isinstance(kind, T.StructType):
        own = fields_of(c)
        made = F.struct(*[(cast_to(own[f.name], f.dataType) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind.fields])
        return F.when(c.col.isNotNull(), made)
    if isinstance(kind, T.ArrayType):
        if isinstance(c.type.elementType, T.NullType):
            return F.when(c.col.isNotNull(), F.array().cast(kind))
        return F.transform(c.col, lambda x: cast_to(Cell(x, c.type.elementType), kind.elementType))
    return c.col.cast(kind)
