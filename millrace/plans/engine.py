"""From syntax trees to Spark plans."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import replace
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import nulls, scalar
from millrace.operators import collapse, groups, intervals, joins, reshape, rows
from millrace.operators.rows import VALUE
from millrace.plans import syntax as s
from millrace.plans.values import (
    DURATION, Builtin, Cell, EvalProblem, Function, GroupNeeded, GroupOf, NotColumnar, Row, Table, Tables,
    cast_to, common_type, fields_of, kind_name, literal, row_of, table_of, to_cell,
)
from millrace.sources import registry

BOOL, LONG, DOUBLE, STRING = T.BooleanType(), T.LongType(), T.DoubleType(), T.StringType()
#: Rows whose expressions are evaluated one by one because they open files.
MOST_PATHS = 10_000
_ROW = "_"
_INNER = "&"

#: Functions of the language that are written in it.
PRELUDE = """
func sample(tbl, n) (tbl | filter(hash64(_) % n == 0));
func basename(path) regexp_replace(path, `^.*/`, ``)
"""


class Engine:
    """A session of the language: global names, files, and the plans they lead to.

    Tables stay lazy; only ``count`` and ``pick`` of a whole table, ``write``, ``print`` and the names of new columns run jobs.
    """

    def __init__(self, spark: SparkSession, overwrite: bool = False, compat_na_join: bool = True) -> None:
        self.spark, self.overwrite, self.compat_na_join = spark, overwrite, compat_na_join
        self.globals: dict[str, Any] = {}
        self.extra: dict[str, Callable] = {}
        self.out: Callable[[str], None] = print
        self.run(PRELUDE)
        self.prelude = dict(self.globals)

    # ------------------------------------------------------------ outside

    def set_global(self, name: str, value: Any) -> None:
        """Make a DataFrame or a Python value known by a name."""
        self._assign(name, table_of(value) if isinstance(value, DataFrame) else literal(value))

    def register(self, name: str, function: Callable[..., Column], returns: T.DataType | str) -> None:
        """Add a function of columns to the language."""
        kind = T._parse_datatype_string(returns) if isinstance(returns, str) else returns
        self.extra[name] = lambda *args: Cell(function(*[to_cell(a).col for a in args]), kind)

    def run(self, text: str, folder: str | None = None) -> Any:
        """Evaluate a program; the value of its last statement, as the language has it."""
        out: Any = None
        for node in s.parse(text):
            if isinstance(node, s.Load):
                remote = "://" in node.path or node.path.startswith("file:")
                path = node.path if remote else str(Path(folder, node.path)) if folder and "://" not in folder else f"{folder}/{node.path}" if folder else node.path
                out = self.run(registry.read_text(self.spark, path), path.rpartition("/")[0] or ".")
            elif isinstance(node, s.Assign):
                out = self.eval(node.value, {})
                self._assign(node.name, out)
            else:
                out = self.eval(node, {})
        return out

    def eval_text(self, text: str) -> Any:
        """The value of a program for Python: a DataFrame for a table, a Row or plain value else."""
        return self.outside(self.run(text))

    def outside(self, v: Any) -> Any:
        if isinstance(v, Table):
            return v.df
        if isinstance(v, Tables):
            return [self.outside(x) for x in v.items]
        if isinstance(v, (Cell, Row)):
            return self.constant(v)
        return v

    def constant(self, v: Any) -> Any:
        """The value of an expression that depends on no row."""
        if isinstance(v, Cell) and v.literal:
            return v.value
        c = to_cell(v)
        if not c.free:
            raise NotColumnar
        return self.spark.range(1).select(c.col.alias("v")).first()[0]

    def _assign(self, name: str, value: Any) -> None:
        if name in self.globals:
            raise EvalProblem(f"{name} is defined already")
        if name in BUILTINS or name in self.extra:
            raise EvalProblem(f"{name} is a function of the language")
        self.globals[name] = value

    # ------------------------------------------------------------ expressions

    def eval(self, node: s.Node, scope: dict[str, Any]) -> Any:
        return getattr(self, "_" + type(node).__name__.lower())(node, scope)

    def _lit(self, node: s.Lit, scope: dict) -> Any:
        if node.kind == "char":
            return Cell(F.lit(node.value), T.CharType(1), True, value=node.value, literal=True)
        return literal(node.value)

    def _var(self, node: s.Var, scope: dict) -> Any:
        if node.name in scope:
            return scope[node.name]
        if node.name in self.globals:
            return self.globals[node.name]
        if node.name in BUILTINS or node.name in self.extra:
            return Builtin(node.name)
        raise EvalProblem(f"{node.name} isn't defined")

    def _rowfield(self, node: s.RowField, scope: dict) -> Any:
        if _INNER not in scope:
            raise EvalProblem(f"&{node.name} outside of a row")
        fields = fields_of(scope[_INNER])
        if fields is None or node.name not in fields:
            raise EvalProblem(f"the row has no column {node.name}")
        return fields[node.name]

    def _field(self, node: s.Field, scope: dict) -> Any:
        of = self.eval(node.of, scope)
        fields = fields_of(of)
        if fields is None:
            if isinstance(of, Cell) and isinstance(of.type, T.NullType):
                return literal(None)
            raise EvalProblem(f"a {kind_name(of)} has no field {node.name}")
        return fields.get(node.name, literal(None))

    def _struct(self, node: s.Struct, scope: dict) -> Row:
        out: dict[str, Any] = {}
        for i, (name, expr) in enumerate(node.fields):
            if isinstance(expr, s.Fields):
                of = scope[_INNER] if expr.of is None else self.eval(expr.of, scope)
                found = {n: v for n, v in (fields_of(of) or {}).items() if re.search(expr.pattern, n)}
                if not found:
                    raise EvalProblem(f"no field matches /{expr.pattern}/")
                out |= found
                continue
            name = name or (expr.name if isinstance(expr, (s.Var, s.RowField, s.Field)) else f"f{i}")
            out[name] = self.eval(expr, scope)
        return Row(out)

    def _fields(self, node: s.Fields, scope: dict) -> Any:
        raise EvalProblem("a pattern of fields belongs in a struct")

    def _lambda(self, node: s.Lambda, scope: dict) -> Function:
        return Function(node.params, node.body, dict(scope))

    def _block(self, node: s.Block, scope: dict) -> Any:
        inner = dict(scope)
        for a in node.statements:
            inner[a.name] = self.eval(a.value, inner)
        return self.eval(node.result, inner)

    def _if(self, node: s.If, scope: dict) -> Any:
        test = to_cell(self.eval(node.condition, scope))
        if not isinstance(test.type, T.BooleanType):
            raise EvalProblem(f"a condition is a bool, not a {kind_name(test)}")
        if test.free:
            return self.eval(node.then if self.constant(test) else node.otherwise, scope)
        a, b = to_cell(self.eval(node.then, scope)), to_cell(self.eval(node.otherwise, scope))
        kind = common_type([a.type, b.type])
        return Cell(F.when(test.col, cast_to(a, kind)).otherwise(cast_to(b, kind)), kind, False)

    def _unary(self, node: s.Unary, scope: dict) -> Cell:
        x = to_cell(self.eval(node.of, scope))
        if node.op == "!":
            self._need_bool(x)
            return Cell(~x.col, BOOL, x.free)
        if isinstance(x.type, T.NullType):
            return Cell(x.col, x.type, x.free, down=x)
        if isinstance(x.type, (T.NumericType, T.DayTimeIntervalType)):
            return Cell(-x.col, x.type, x.free, down=x)
        if isinstance(x.type, T.StringType):
            return Cell(scalar.negated_text(x.col), STRING, x.free, down=x)
        return Cell(x.col, x.type, x.free, down=x)

    def _need_bool(self, *cells: Cell) -> None:
        for c in cells:
            if not isinstance(c.type, T.BooleanType):
                raise EvalProblem(f"&& || ! take bools, not a {kind_name(c)}")

    def _op(self, node: s.Op, scope: dict) -> Cell:
        a, b = to_cell(self.eval(node.left, scope)), to_cell(self.eval(node.right, scope))
        if node.op in ("==", "!=") and isinstance(a.type, T.NullType) and isinstance(b.type, T.NullType):
            same = (a.down is None) == (b.down is None)  # the missing value and its negation differ
            return literal(same if node.op == "==" else not same)
        return self.operate(node.op, a, b)

    def operate(self, op: str, a: Cell, b: Cell) -> Cell:
        free = a.free and b.free
        if op in ("&&", "||"):
            self._need_bool(a, b)
            both = (lambda x, y: x & y) if op == "&&" else (lambda x, y: x | y)
            where = both(a.where if a.where is not None else a.col, b.where if b.where is not None else b.col) if a.where is not None or b.where is not None else None
            return Cell(both(a.col, b.col), BOOL, free, where)
        if op in "+-*/%":
            return self._arithmetic(op, a, b, free)
        if op in ("<", "<="):
            a, b, op = b, a, {"<": ">", "<=": ">="}[op]
        x, y = self._comparable(a, b)
        if op in (">", ">="):
            if op == ">":
                made, where = nulls.gt(x, y), nulls.where_gt(x, y, b.literal and b.value is not None)
            else:
                made, where = nulls.ge(x, y), nulls.where_ge(x, y)
            if a.literal and a.value is not None:
                where = x > y if op == ">" else x >= y  # a value is never greater than a missing one
            if scalar.is_float(a.type) and not a.literal:
                # Spark has NaN above all numbers, the statistics of files don't; here it is neither above nor below any.
                made, where = made & ~F.isnan(x), where & ~F.isnan(x)
            return Cell(made, BOOL, free, where)
        named = {"==": nulls.eq, "!=": nulls.ne, "==?": nulls.eq_or_right_null, "?==": nulls.eq_or_left_null, "?==?": nulls.eq_or_either_null}
        if op == "==" and b.literal and b.value is not None:
            return Cell(nulls.eq(x, y), BOOL, free, x == y)
        return Cell(named[op](x, y), BOOL, free)

    def _comparable(self, a: Cell, b: Cell) -> tuple[Column, Column]:
        number = isinstance(a.type, T.NumericType) and isinstance(b.type, T.NumericType)
        moments = (T.DateType, T.TimestampType, T.TimestampNTZType)
        moment = isinstance(a.type, moments) and isinstance(b.type, moments)
        texts = (T.StringType, T.CharType)
        if not (number or moment or a.type == b.type or isinstance(a.type, T.NullType) or isinstance(b.type, T.NullType) or isinstance(a.type, texts) and isinstance(b.type, texts)):
            raise EvalProblem(f"a {kind_name(a)} can't be compared with a {kind_name(b)}")
        return self._as_stored(a, b), self._as_stored(b, a)

    @staticmethod
    def _as_stored(a: Cell, other: Cell) -> Column:
        """A moment written in the program, compared with times stored without a zone, which are UTC: the literal changes, not the column, so scans still take the filter."""
        if isinstance(other.type, T.TimestampNTZType) and a.literal and isinstance(a.value, datetime):
            return F.lit(a.value.astimezone(UTC).replace(tzinfo=None).isoformat(" ")).cast("timestamp_ntz")
        return a.col

    def _arithmetic(self, op: str, a: Cell, b: Cell, free: bool) -> Cell:
        text = (T.StringType, T.CharType)
        if op == "+" and isinstance(a.type, text) and isinstance(b.type, text):
            return Cell(F.concat(a.col, b.col), STRING, free)
        if op in "+-" and isinstance(a.type, T.DayTimeIntervalType) and isinstance(b.type, T.DayTimeIntervalType):
            return Cell(a.col + b.col if op == "+" else a.col - b.col, DURATION, free)
        kinds = [k for k in (a.type, b.type) if not isinstance(k, T.NullType)]
        if not all(isinstance(k, T.NumericType) for k in kinds) or op == "%" and any(scalar.is_float(k) for k in kinds):
            raise EvalProblem(f"{op} doesn't take a {kind_name(a)} and a {kind_name(b)}")
        floats = any(scalar.is_float(k) for k in kinds)
        kind = DOUBLE if floats else LONG
        x, y = a.col.cast(kind), b.col.cast(kind)
        if op == "/":
            return Cell(scalar.divide(x, y, floats).cast(kind), kind, free)
        return Cell({"+": x.__add__, "-": x.__sub__, "*": x.__mul__, "%": x.__mod__}[op](y), kind, free)

    # ------------------------------------------------------------ calls

    def _call(self, node: s.Call, scope: dict) -> Any:
        f = self.eval(node.function, scope)
        if isinstance(f, Builtin):
            if f.name in self.extra:
                return self.extra[f.name](*[self.eval(a, scope) for a in node.args])
            return BUILTINS[f.name](Arguments(self, f.name, node, scope))
        if isinstance(f, Function):
            if node.named:
                raise EvalProblem("functions written in the language take no named arguments")
            return self.apply(f, [self.eval(a, scope) for a in node.args])
        raise EvalProblem(f"a {kind_name(f)} can't be called")

    def apply(self, f: Any, args: list[Any]) -> Any:
        if isinstance(f, Builtin):
            names = {f"__arg{i}": a for i, a in enumerate(args)}
            return self._call(s.Call(s.Var(f.name), tuple(map(s.Var, names))), names)
        if len(args) != len(f.params):
            raise EvalProblem(f"the function takes {len(f.params)} arguments, not {len(args)}")
        return self.eval(f.body, f.scope | dict(zip(f.params, args)))


class Arguments:
    """The arguments of a call of a built-in function, evaluated when and how the function wants them."""

    def __init__(self, engine: Engine, name: str, node: s.Call, scope: dict) -> None:
        self.engine, self.name, self.scope = engine, name, scope
        self.nodes, self.named = list(node.args), dict(node.named)

    def __len__(self) -> int:
        return len(self.nodes)

    def take(self, least: int, most: int | None = None, named: tuple[str, ...] = ()) -> None:
        most = least if most is None else most
        if not least <= len(self.nodes) <= most:
            raise EvalProblem(f"{self.name} takes {least}{f' to {most}' * (most != least)} arguments, not {len(self.nodes)}")
        if unknown := set(self.named) - set(named):
            raise EvalProblem(f"{self.name} has no argument {sorted(unknown)[0]}")

    def value(self, i: int | str) -> Any:
        return self.engine.eval(self.named[i] if isinstance(i, str) else self.nodes[i], self.scope)

    def cell(self, i: int | str) -> Cell:
        return to_cell(self.value(i))

    def all(self) -> list[Cell]:
        return [self.cell(i) for i in range(len(self.nodes))]

    def constant(self, i: int | str, default: Any = None) -> Any:
        if isinstance(i, str) and i not in self.named or isinstance(i, int) and i >= len(self.nodes):
            return default
        return self.engine.constant(self.value(i))

    def per_row(self, i: int | str, row: Any, second: Any = None, second_name: str = "feat") -> Any:
        """An argument as an expression of a row; if it is a function, applied to the row."""
        name = self.named["row"].name if isinstance(self.named.get("row"), s.Var) else _ROW
        scope = self.scope | {_ROW: row, _INNER: row, name: row} | ({second_name: second} if second is not None else {})
        v = self.engine.eval(self.named[i] if isinstance(i, str) else self.nodes[i], scope)
        if isinstance(v, (Function, Builtin)):
            return self.engine.apply(v, [row] if second is None or len(getattr(v, "params", ())) == 1 else [row, second])
        return v


BUILTINS: dict[str, Callable[[Arguments], Any]] = {}


def builtin(name: str, least: int, most: int | None = None, named: tuple[str, ...] = ()):  # noqa: ANN201
    def wrap(f: Callable[[Arguments], Any]) -> Callable[[Arguments], Any]:
        def checked(a: Arguments) -> Any:
            a.take(least, most, named)
            return f(a)

        checked.__doc__ = f.__doc__
        BUILTINS[name] = checked
        return checked

    return wrap


MANY = 63

# ---------------------------------------------------------------- scalar functions


def _scalar(name: str, kinds: tuple, result: T.DataType, make: Callable[..., Column], least: int | None = None) -> None:
    """A function of cells of the given types."""

    def f(a: Arguments) -> Cell:
        cells = a.all()
        for c, k in zip(cells, kinds):
            if k is not None and not isinstance(c.type, (*k, T.NullType) if isinstance(k, tuple) else (k, T.NullType)):
                raise EvalProblem(f"{name} doesn't take a {kind_name(c)}")
        return Cell(make(*[c.col for c in cells]), result, all(c.free for c in cells))

    builtin(name, len(kinds) if least is None else least, len(kinds))(f)


_TEXT, _WHOLE = (T.StringType, T.CharType), (T.LongType, T.IntegerType)
_scalar("string_len", (_TEXT,), LONG, scalar.string_len)
_scalar("substring", (_TEXT, _WHOLE, _WHOLE), STRING, scalar.substring, 2)
_scalar("string_replace", (_TEXT, _TEXT, _TEXT), STRING, F.replace)
_scalar("string_has_prefix", (_TEXT, _TEXT), BOOL, F.startswith)
_scalar("string_has_suffix", (_TEXT, _TEXT), BOOL, F.endswith)
_scalar("string_count", (_TEXT, _TEXT), LONG, scalar.string_count)
_scalar("isset", (_WHOLE, _WHOLE), BOOL, scalar.isset)
_scalar("land", (_WHOLE, _WHOLE), LONG, lambda x, y: x.bitwiseAND(y))
_scalar("lor", (_WHOLE, _WHOLE), LONG, lambda x, y: x.bitwiseOR(y))


@builtin("regexp_match", 2)
def _regexp_match(a: Arguments) -> Cell:
    x = a.cell(0)
    return Cell(scalar.regexp_match(x.col, a.constant(1)), BOOL, x.free)


@builtin("regexp_replace", 3)
def _regexp_replace(a: Arguments) -> Cell:
    x = a.cell(0)
    return Cell(scalar.regexp_replace(x.col, a.constant(1), a.constant(2)), STRING, x.free)


@builtin("sprintf", 1, MANY)
def _sprintf(a: Arguments) -> Cell:
    args = [a.cell(i) for i in range(1, len(a))]
    return Cell(scalar.sprintf(a.constant(0), [(c.col, c.type) for c in args]), STRING, all(c.free for c in args))


@builtin("int", 1)
def _int(a: Arguments) -> Cell:
    c = a.cell(0)
    return Cell(F.ascii(c.col).cast("long") if isinstance(c.type, T.CharType) else scalar.to_int(c.col, c.type), LONG, c.free)


@builtin("float", 1)
def _float(a: Arguments) -> Cell:
    c = a.cell(0)
    return Cell(scalar.to_float(c.col, c.type), DOUBLE, c.free)


@builtin("string", 1)
def _string(a: Arguments) -> Cell:
    c = a.cell(0)
    return Cell(scalar.to_string(c.col, c.type), STRING, c.free)


@builtin("isnull", 1)
def _isnull(a: Arguments) -> Cell:
    v = a.value(0)
    return literal(False) if isinstance(v, (Row, Table, Tables, GroupOf)) else Cell(v.col.isNull(), BOOL, v.free)


@builtin("isstruct", 1)
def _isstruct(a: Arguments) -> Cell:
    return literal(fields_of(a.value(0)) is not None)


@builtin("istable", 1)
def _istable(a: Arguments) -> Cell:
    v = a.value(0)
    return literal(isinstance(v, (Table, Tables, GroupOf)) or isinstance(v, Cell) and isinstance(v.type, T.ArrayType))


def _extreme(a: Arguments, pick: Callable[..., Column]) -> Cell:
    cells = a.all()
    kind = common_type([c.type for c in cells])
    return Cell(pick(*[cast_to(c, kind) for c in cells]), kind, all(c.free for c in cells))


@builtin("max", 1, MANY)
def _max(a: Arguments) -> Cell:
    return _extreme(a, nulls.greatest)


@builtin("min", 1, MANY)
def _min(a: Arguments) -> Cell:
    return _extreme(a, nulls.least)


@builtin("hash64", 1)
def _hash64(a: Arguments) -> Cell:
    c = a.cell(0)
    return Cell(scalar.hash64(c.col), LONG, c.free)


@builtin("contains", 2)
def _contains(a: Arguments) -> Cell:
    fields = fields_of(a.value(0))
    name = a.constant(1)
    return literal(fields is not None and name in fields)


@builtin("optionalfield", 2, 2, ("default",))
def _optionalfield(a: Arguments) -> Any:
    fields = fields_of(a.value(0)) or {}
    name = a.nodes[1].name if isinstance(a.nodes[1], s.Var) else a.constant(1)
    return fields[name] if name in fields else a.value("default") if "default" in a.named else literal(None)


@builtin("unionrow", 2)
def _unionrow(a: Arguments) -> Row:
    x, y = fields_of(a.value(0)), fields_of(a.value(1))
    if x is None or y is None:
        raise EvalProblem("unionrow takes structs")
    return Row({n: y.get(n, v) for n, v in x.items()} | {n: v for n, v in y.items() if n not in x})


# ---------------------------------------------------------------- tables


def _condition(v: Any) -> Column:
    c = to_cell(v)
    if not isinstance(c.type, (T.BooleanType, T.NullType)):
        raise EvalProblem(f"a condition is a bool, not a {kind_name(c)}")
    return c.col if c.where is None else c.where


def _is_cell_table(v: Any) -> bool:
    return isinstance(v, Cell) and isinstance(v.type, (T.ArrayType, T.NullType))


def _items(c: Cell) -> tuple[Column, T.DataType]:
    """The rows of a table in a cell; a missing table is an empty one."""
    if isinstance(c.type, T.NullType):
        return F.array(), T.NullType()
    return F.coalesce(c.col, F.array().cast(c.type)), c.type.elementType


def _whole(a: Arguments, v: Any) -> Table:
    if isinstance(v, GroupOf):
        raise GroupNeeded
    if isinstance(v, Table):
        return v
    if isinstance(v, Cell) and v.free and isinstance(v.type, T.ArrayType):
        return Table(lambda: rows.expand(a.engine.spark.range(1).select(F.explode(v.col).alias(VALUE))), v)
    raise EvalProblem(f"{a.name} takes a table, not a {kind_name(v)}")


@builtin("table", 0, 100_000)
def _table(a: Arguments) -> Any:
    values = [a.value(i) for i in range(len(a))]
    spark = a.engine.spark
    if not values:
        return Table(lambda: spark.createDataFrame([], T.StructType([])), Cell(F.array(), T.ArrayType(T.NullType()), True))
    if any(isinstance(v, (Table, Tables)) for v in values):
        return Tables(values)
    cells = [to_cell(v) for v in values]
    kind = common_type([c.type for c in cells])
    items = F.array(*[cast_to(c, kind) for c in cells])
    return Table(lambda: rows.expand(spark.range(1).select(F.explode(items).alias(VALUE))), Cell(items, T.ArrayType(kind), all(c.free for c in cells)))


def _outputs(cells: list[Any]) -> list[Column]:
    cells = [to_cell(c) for c in cells]
    kind = common_type([c.type for c in cells])
    return [cast_to(c, kind) for c in cells]


def _map_table(a: Arguments, t: Table, outputs: list[int | str], where: int | str | None) -> Any:
    row = row_of(t.df)
    try:
        condition = None if where is None else _condition(a.per_row(where, row))
        made = [a.per_row(i, row) for i in outputs]
        if any(isinstance(v, (Table, Tables)) and (isinstance(v, Tables) or v.cell is None) for v in made):
            raise NotColumnar
        if not made:
            return table_of(t.df.where(condition))
        return table_of(rows.map_rows(t.df, *_outputs(made), where=condition))
    except NotColumnar:
        df = t.df if where is None else t.df.where(_condition(a.per_row(where, row)))
        found = df.limit(MOST_PATHS + 1).collect()
        if len(found) > MOST_PATHS:
            raise EvalProblem(f"more than {MOST_PATHS} rows to open files for") from None
        kinds = df.schema
        values = [literal(r[0], kinds[0].dataType) if df.columns == [VALUE] else literal(r, kinds) for r in found]
        return Tables([a.per_row(i, v) for v in values for i in outputs])


def _map_group(a: Arguments, t: Table, outputs: list[int | str]) -> Table | None:
    """A map over groups that asks only for keys and aggregates of the groups' rows: one aggregation. Null if it asks for more."""
    src, key, value = t.group
    group = GroupOf(table_of(src), value, {})
    row = Row({"key": Cell(F.col("key"), key.type), "value": group})
    try:
        made = _outputs([a.per_row(i, row) for i in outputs])
    except GroupNeeded:
        return None
    return table_of(rows.map_rows(groups.group_aggregate(src, key.col, group.wanted or {"__n": F.count("*")}), *made))


def _map(a: Arguments, outputs: list[int | str], where: int | str | None) -> Any:
    v = a.value(0)
    if isinstance(v, Tables):
        if where is not None:
            raise EvalProblem("tables of tables can't be filtered")
        return Tables([a.per_row(i, x) for x in v.items for i in outputs])
    if isinstance(v, Table):
        if v.group is not None and where is None and (done := _map_group(a, v, outputs)) is not None:
            return done
        return _map_table(a, v, outputs, where)
    if isinstance(v, GroupOf):
        if len(outputs) > 1:
            raise GroupNeeded
        if where is not None:
            v = replace(v, where=v.holds(to_cell(a.per_row(where, v.item)).col))
        return replace(v, value=to_cell(a.per_row(outputs[0], v.item))) if outputs else v
    if not _is_cell_table(v):
        raise EvalProblem(f"{a.name} takes a table, not a {kind_name(v)}")
    items, kind = _items(v)
    if where is not None:
        items = F.filter(items, lambda x: F.coalesce(to_cell(a.per_row(where, Cell(x, kind))).col, F.lit(False)))
    if not outputs:
        return Cell(items, T.ArrayType(kind), v.free)
    cells = [to_cell(a.per_row(i, Cell(F.col("x"), kind))) for i in outputs]
    out = common_type([c.type for c in cells])
    if len(outputs) == 1:
        made = F.transform(items, lambda x: cast_to(to_cell(a.per_row(outputs[0], Cell(x, kind))), out))
    else:
        made = F.flatten(F.transform(items, lambda x: F.array(*[cast_to(to_cell(a.per_row(i, Cell(x, kind))), out) for i in outputs])))
    return Cell(made, T.ArrayType(out), v.free)


@builtin("map", 2, MANY, ("filter", "shards", "row"))
def _map_builtin(a: Arguments) -> Any:
    return _map(a, list(range(1, len(a))), "filter" if "filter" in a.named else None)


@builtin("filter", 2, 2, ("map", "shards", "row"))
def _filter_builtin(a: Arguments) -> Any:
    return _map(a, ["map"] if "map" in a.named else [], 1)


@builtin("firstn", 2)
def _firstn(a: Arguments) -> Any:
    v, n = a.value(0), a.constant(1)
    if _is_cell_table(v):
        items, kind = _items(v)
        return Cell(F.slice(items, 1, n), T.ArrayType(kind), v.free)
    if isinstance(v, Tables):
        return Tables(v.items[:n])
    return table_of(rows.first_rows(_whole(a, v).df, n))


@builtin("pick", 2, 2, ("row",))
def _pick(a: Arguments) -> Any:
    v = a.value(0)
    if isinstance(v, GroupOf):
        if v.order is None:
            raise GroupNeeded
        item, holds = to_cell(v.item), v.holds(to_cell(a.per_row(1, v.item)).col)
        return v.aggregate(F.min_by(item.col, F.when(holds, F.struct(*v.order))), item.type)
    if _is_cell_table(v) and not v.free:
        items, kind = _items(v)
        return Cell(F.get(F.filter(items, lambda x: F.coalesce(to_cell(a.per_row(1, Cell(x, kind))).col, F.lit(False))), F.lit(0)), kind)
    df = _whole(a, v).df
    found = rows.pick(df, _condition(a.per_row(1, row_of(df)))).first()
    if found is None:
        return literal(None)
    return literal(found[0], df.schema[0].dataType) if df.columns == [VALUE] else literal(found, df.schema)


@builtin("count", 1)
def _count(a: Arguments) -> Cell:
    v = a.value(0)
    if isinstance(v, GroupOf):
        return v.aggregate(F.count("*") if v.where is None else F.count_if(v.holds()), LONG)
    if isinstance(v, Tables):
        return literal(len(v.items))
    if _is_cell_table(v):
        return Cell(F.size(_items(v)[0]).cast("long"), LONG, v.free)
    return literal(_whole(a, v).df.count())


def _sort_keys(v: Any) -> list[Column]:
    parts = list(v.fields.values()) if isinstance(v, Row) else [v]
    return [nulls.descending(to_cell(p.down).col) if isinstance(p, Cell) and p.down is not None else nulls.ascending(to_cell(p).col) for p in parts]


def _rising(v: Any) -> list[Column]:
    """Columns by which the smallest struct is the first row: missing values last, or first under a descending key."""
    out: list[Column] = []
    for p in v.fields.values() if isinstance(v, Row) else [v]:
        if not (isinstance(p, Cell) and p.down is not None):
            k = to_cell(p).col
            out += [k.isNull(), k]
            continue
        k, kind = p.down.col, p.down.type
        if isinstance(kind, T.IntegralType):
            out += [k.isNotNull(), F.bitwise_not(k)]
        elif isinstance(kind, T.FractionalType):
            out += [k.isNotNull(), ~F.isnan(k), -k]
        elif isinstance(kind, T.StringType):
            out += [k.isNotNull(), scalar.negated_text(k)]
        else:
            raise GroupNeeded
    return [c.alias(f"o{i}") for i, c in enumerate(out)]


def _sorted(a: Arguments, n: int, key: int) -> Any:
    v = a.value(0)
    if isinstance(v, GroupOf):
        if n >= 0 or v.order is not None:
            raise GroupNeeded
        return replace(v, order=_rising(a.per_row(key, v.item)))
    if _is_cell_table(v) and not v.free:
        items, kind = _items(v)
        made = a.per_row(key, Cell(F.col("x"), kind))
        downs = [isinstance(p, Cell) and p.down is not None for p in (made.fields.values() if isinstance(made, Row) else [made])]

        def keys(x: Column) -> list[Column]:
            k = a.per_row(key, Cell(x, kind))
            return [to_cell(p.down if d else p).col for p, d in zip(k.fields.values() if isinstance(k, Row) else [k], downs)]

        def order(x: Column, y: Column) -> Column:
            out = F.lit(0)
            for p, q, d in reversed(list(zip(keys(x), keys(y), downs))):
                p, q = (q, p) if d else (p, q)
                out = F.when(nulls.gt(p, q), 1).when(nulls.gt(q, p), -1).otherwise(out)
            return out

        made_items = F.array_sort(items, order)
        return Cell(made_items if n < 0 else F.slice(made_items, 1, n), T.ArrayType(kind))
    df = _whole(a, v).df
    return table_of(rows.min_rows(df, n, *_sort_keys(a.per_row(key, row_of(df)))))


@builtin("sort", 2, 2, ("shards", "row"))
def _sort(a: Arguments) -> Any:
    return _sorted(a, -1, 1)


@builtin("minn", 3, 3, ("shards", "row"))
def _minn(a: Arguments) -> Any:
    return _sorted(a, a.constant(1), 2)


# ---------------------------------------------------------------- groups


def native_fold(f: Any, kind: T.DataType) -> str | dict[str, str] | None:
    """The native aggregate that a folding function amounts to, by field if it folds structs; null if there is none."""
    if isinstance(f, Builtin):
        return f.name if f.name in groups.NATIVE else None
    if not isinstance(f, Function) or len(f.params) != 2:
        return None
    body = f.body
    while isinstance(body, s.Block) and not body.statements:
        body = body.result

    def amounts(node: s.Node, x: s.Node, y: s.Node, of: T.DataType) -> str | None:
        if isinstance(node, s.Op) and node.op in groups.NATIVE and (node.left, node.right) in ((x, y), (y, x)):
            return node.op if isinstance(of, T.BooleanType) or node.op in "+*" and isinstance(of, T.NumericType) else None
        if isinstance(node, s.Call) and isinstance(node.function, s.Var) and node.function.name in ("max", "min", "land", "lor") and node.args in ((x, y), (y, x)):
            return node.function.name
        return None

    x, y = s.Var(f.params[0]), s.Var(f.params[1])
    if isinstance(body, s.Struct) and isinstance(kind, T.StructType):
        out = {}
        for name, expr in body.fields:
            how = name in kind.names and amounts(expr, s.Field(x, name), s.Field(y, name), kind[name].dataType)
            if not how:
                return None
            out[name] = how
        return out if list(out) == kind.names else None
    return amounts(body, x, y, kind)


def _legacy(a: Arguments, i: int) -> Any:
    """A folding function, or the older form, an expression of ``_acc`` and ``_val``."""
    node = a.nodes[i]
    if isinstance(node, s.Lambda) or isinstance(node, s.Var):
        return a.value(i)
    return Function(("_acc", "_val"), node, dict(a.scope))


@builtin("reduce", 3, 3, ("map", "shards", "row"))
def _reduce(a: Arguments) -> Any:
    v = a.value(0)
    if isinstance(v, (GroupOf,)) or _is_cell_table(v) and not v.free:
        return _reduce_cell(a, v)
    df = _whole(a, v).df
    row = row_of(df)
    key = to_cell(a.per_row(1, row))
    value = to_cell(a.per_row("map", row) if "map" in a.named else row)
    f = _legacy(a, 2)
    how = native_fold(f, value.type)
    if isinstance(how, dict):
        made = F.struct(*[groups._missing_is_greatest(h)(value.col.getField(n)).alias(n) for n, h in how.items()])
        return table_of(df.groupBy(key.col.alias("key")).agg(made.alias("value")))
    if how is not None:
        return table_of(groups.fold(df, key.col, value.col, how))

    def step(x: Column, y: Column) -> Column:
        return cast_to(to_cell(a.engine.apply(f, [Cell(x, value.type), Cell(y, value.type)])), value.type)

    return table_of(groups.fold(df, key.col, value.col, step))


def _keyed(a: Arguments, v: Cell) -> tuple[Column, Column, T.DataType, T.DataType]:
    """Of a table in a cell: its distinct keys, its rows as pairs of key and value, and the types of both."""
    items, kind = _items(v)
    made = "map" if "map" in a.named else None

    def pair(x: Column) -> tuple[Cell, Cell]:
        return to_cell(a.per_row(1, Cell(x, kind))), to_cell(a.per_row(made, Cell(x, kind))) if made else Cell(x, kind)

    key, value = (c.type for c in pair(F.col("x")))
    pairs = F.transform(items, lambda x: F.struct(pair(x)[0].col.alias("key"), pair(x)[1].col.alias("value")))
    return F.array_distinct(F.transform(pairs, lambda p: p["key"])), pairs, key, value


def _reduce_group(a: Arguments, v: GroupOf) -> Cell:
    """A fold of all rows of a group under one key: a table of one row, or none."""
    key, value = to_cell(a.per_row(1, v.item)), to_cell(a.per_row("map", v.item) if "map" in a.named else v.item)
    how = native_fold(_legacy(a, 2), value.type)
    if not key.free or how is None:
        raise GroupNeeded
    if isinstance(how, dict):
        total = F.struct(*[groups.folded_where(h, value.col.getField(n), v.holds()).alias(n) for n, h in how.items()])
    else:
        total = groups.folded_where(how, value.col, v.holds())
    n, folded = v.aggregate(F.count_if(v.holds()), LONG), v.aggregate(total, value.type)
    kind = T.ArrayType(T.StructType([T.StructField("key", key.type), T.StructField("value", value.type)]))
    return Cell(F.when(n.col > 0, F.array(F.struct(key.col.alias("key"), folded.col.alias("value")))).otherwise(F.array().cast(kind)), kind)


def _reduce_cell(a: Arguments, v: Any) -> Cell:
    """A fold of a table in a cell: the keys in turn, each with the fold of its values."""
    if isinstance(v, GroupOf):
        return _reduce_group(a, v)
    keys, pairs, key, value = _keyed(a, v)
    f = _legacy(a, 2)

    def folded(k: Column) -> Column:
        own = F.transform(F.filter(pairs, lambda p: p["key"].eqNullSafe(k)), lambda p: p["value"])
        total = F.aggregate(F.slice(own, 2, F.size(own)), F.get(own, F.lit(0)), lambda x, y: cast_to(to_cell(a.engine.apply(f, [Cell(x, value), Cell(y, value)])), value))
        return F.struct(k.alias("key"), total.alias("value"))

    return Cell(F.transform(keys, folded), T.ArrayType(T.StructType([T.StructField("key", key), T.StructField("value", value)])))


@builtin("cogroup", 2, 2, ("map", "shards", "row"))
def _cogroup(a: Arguments) -> Any:
    v = a.value(0)
    if isinstance(v, GroupOf):
        raise GroupNeeded
    if _is_cell_table(v) and not v.free:
        keys, pairs, key, value = _keyed(a, v)

        def listed(k: Column) -> Column:
            return F.struct(k.alias("key"), F.transform(F.filter(pairs, lambda p: p["key"].eqNullSafe(k)), lambda p: p["value"]).alias("value"))

        return Cell(F.transform(keys, listed), T.ArrayType(T.StructType([T.StructField("key", key), T.StructField("value", T.ArrayType(value))])))
    df = _whole(a, v).df
    row = row_of(df)
    key = to_cell(a.per_row(1, row))
    value = to_cell(a.per_row("map", row)) if "map" in a.named else None
    return Table(lambda: groups.group_rows(df, key.col, None if value is None else value.col), group=(df, key, value))


# ---------------------------------------------------------------- joins


@builtin("join", 2, 2, ("map",))
def _join(a: Arguments) -> Any:
    named = a.value(0)
    if not isinstance(named, Row):
        raise EvalProblem("join takes a struct of tables")
    if any(_is_cell_table(t) and not t.free for t in named.fields.values()):
        return _join_cells(a, named.fields)
    tables = {n: _whole(a, t).df for n, t in named.fields.items()}

    def row(name: str) -> Any:
        df = tables[name]
        if df.columns == [VALUE]:
            return Cell(F.col(f"`{name}`"), df.schema[0].dataType)
        return Row({f.name: Cell(F.col(f"`{name}_{f.name}`"), f.dataType) for f in df.schema.fields})

    inner = a.scope | {n: row(n) for n in tables}
    matches: list[joins.Match] = []

    def key(node: s.Node) -> tuple[str, str] | None:
        if isinstance(node, s.Field) and isinstance(node.of, s.Var) and node.of.name in tables:
            return (node.of.name, node.name) if node.name in tables[node.of.name].columns else None
        return (node.name, VALUE) if isinstance(node, s.Var) and node.name in tables and tables[node.name].columns == [VALUE] else None

    def walk(node: s.Node) -> None:
        if isinstance(node, s.Op) and node.op == "&&":
            walk(node.left)
            walk(node.right)
        elif isinstance(node, s.Op) and node.op in joins.KINDS and (x := key(node.left)) and (y := key(node.right)) and x[0] != y[0]:
            matches.append(joins.Match(*x, node.op, *y))

    walk(a.nodes[1])
    condition = a.nodes[1]
    if len(tables) == 2 and len(matches) == 1 and isinstance(condition, s.Op) and condition.op == "&&" and _misses(condition.right, matches[0], key):
        out = joins.without_partner(tables, matches[0])
    else:
        out = joins.join_tables(tables, matches, lambda: _condition(a.engine.eval(condition, inner)), a.engine.compat_na_join)
    if "map" not in a.named:
        return table_of(out)
    v = a.engine.eval(a.named["map"], inner)
    if isinstance(v, (Function, Builtin)):
        v = a.engine.apply(v, [inner[n] for n in tables])
    return table_of(rows.map_rows(out, *_outputs([v])))


def _misses(node: s.Node, m: joins.Match, key: Callable) -> bool:
    """Whether a condition says that the key of the side that may be absent is missing."""
    absent = {"==?": (m.right, m.right_key), "?==": (m.left, m.left_key)}.get(m.op)
    return isinstance(node, s.Call) and node.function == s.Var("isnull") and len(node.args) == 1 and absent is not None and key(node.args[0]) == absent


def _join_cells(a: Arguments, named: dict[str, Any]) -> Cell:
    """A join of two tables in cells of one row: pairs for which the condition holds, and rows without any for which it holds with the other side missing."""
    if len(named) != 2:
        raise EvalProblem("tables in cells are joined two at a time")
    (n, x), (m, y) = ((name, _items(to_cell(t))) for name, t in named.items())

    def missing(kind: T.DataType) -> Column:
        return F.lit(None).cast(kind)

    def evaluate(node: s.Node, p: Column, q: Column) -> Any:
        v = a.engine.eval(node, a.scope | {n: Cell(p, x[1]), m: Cell(q, y[1])})
        return a.engine.apply(v, [Cell(p, x[1]), Cell(q, y[1])]) if isinstance(v, (Function, Builtin)) else v

    def holds(p: Column, q: Column) -> Column:
        return F.coalesce(to_cell(evaluate(a.nodes[1], p, q)).col, F.lit(False))

    def both(p: Column, q: Column) -> Column:
        if "map" in a.named:
            return to_cell(evaluate(a.named["map"], p, q)).col
        fields = {name if f is None else f"{name}_{f}": c for name, v, kind in ((n, p, x[1]), (m, q, y[1])) for f, c in ((f, c.col) for f, c in (fields_of(Cell(v, kind)) or {None: Cell(v, kind)}).items())}
        return F.struct(*[c.alias(name) for name, c in fields.items()])

    def left(p: Column) -> Column:
        found = F.filter(y[0], lambda q: holds(p, q))
        alone = F.when(holds(p, missing(y[1])), F.array(missing(y[1]))).otherwise(F.array().cast(T.ArrayType(y[1])))
        return F.transform(F.when(F.size(found) > 0, found).otherwise(alone), lambda q: both(p, q))

    rest = F.filter(y[0], lambda q: ~F.exists(x[0], lambda p: holds(p, q)) & holds(missing(x[1]), q))
    out = F.concat(F.flatten(F.transform(x[0], left)), F.transform(rest, lambda q: both(missing(x[1]), q)))
    if "map" in a.named:
        kind = to_cell(evaluate(a.named["map"], missing(x[1]), missing(y[1]))).type
    else:
        parts = [T.StructField(name if f is None else f"{name}_{f}", k) for name, of in ((n, x[1]), (m, y[1])) for f, k in ([(f.name, f.dataType) for f in of.fields] if isinstance(of, T.StructType) else [(None, of)])]
        kind = T.StructType(parts)
    return Cell(out, T.ArrayType(kind))


#: Features that tables in cells are compared with.
MOST_FEATURES = 10_000


def _joinbed_cell(a: Arguments, v: Cell) -> Cell:
    """An interval join of a table in a cell with few features: a table in a cell, or one of at most MOST_FEATURES rows."""
    items, kind = _items(v)
    other = a.value(1)
    if isinstance(other, Table) and other.cell is None:
        found = other.df.limit(MOST_FEATURES + 1).collect()
        if len(found) > MOST_FEATURES:
            raise EvalProblem(f"more than {MOST_FEATURES} features for tables in cells")
        other = literal(found, T.ArrayType(other.df.schema))
    features, of = _items(to_cell(other))

    def overlap(x: Column, f: Column) -> Column:
        row = Cell(x, kind)
        chrom, start, end = (to_cell(a.per_row(c, row) if c in a.named else fields_of(row)[c]).col if c != "end" or "length" not in a.named else None for c in ("chrom", "start", "end"))
        if end is None:
            end = start + to_cell(a.per_row("length", row)).col
        hit = (chrom == f["chrom"]) & (start < f["end"]) & (f["start"] < end) & (start < end) & (f["start"] < f["end"])
        return F.coalesce(hit, F.lit(False))

    if "map" not in a.named:
        return Cell(F.filter(items, lambda x: F.exists(features, lambda f: overlap(x, f))), T.ArrayType(kind))
    made = to_cell(a.per_row("map", Cell(F.col("x"), kind), Cell(F.col("y"), of))).type

    def outputs(x: Column) -> Column:
        return F.array_distinct(F.transform(F.filter(features, lambda f: overlap(x, f)), lambda f: to_cell(a.per_row("map", Cell(x, kind), Cell(f, of))).col))

    return Cell(F.flatten(F.transform(items, outputs)), T.ArrayType(made))


@builtin("joinbed", 2, 2, ("chrom", "start", "end", "length", "map", "row"))
def _joinbed(a: Arguments) -> Any:
    if _is_cell_table(v := a.value(0)) and not v.free:
        return _joinbed_cell(a, v)
    df, features = _whole(a, a.value(0)).df, _whole(a, a.value(1)).df
    if features.columns[:3] != ["chrom", "start", "end"]:
        raise EvalProblem("the columns of the features begin with chrom, start and end")
    row = row_of(df)

    def column(name: str) -> Column:
        return to_cell(a.per_row(name, row) if name in a.named else fields_of(row)[name]).col

    start = column("start")
    end = start + column("length") if "length" in a.named else column("end")
    if "map" not in a.named:
        return table_of(intervals.overlap_join(df, features, column("chrom"), start, end))
    kinds = df.schema[0].dataType if df.columns == [VALUE] else df.schema

    def output(r: Column, f: Column) -> Column:
        return to_cell(a.per_row("map", Cell(r, kinds), Cell(f, features.schema))).col

    return table_of(intervals.overlap_join(df, features, column("chrom"), start, end, output))


# ---------------------------------------------------------------- reshaping


@builtin("concat", 1, MANY)
def _concat(a: Arguments) -> Any:
    values = [a.value(i) for i in range(len(a))]
    if all(_is_cell_table(v) or isinstance(v, Table) and v.cell is not None for v in values) and any(isinstance(v, Cell) for v in values):
        cells = [to_cell(v) for v in values]
        kind = common_type([c.type for c in cells])
        return Cell(F.concat(*[F.coalesce(cast_to(c, kind), F.array().cast(kind)) for c in cells]), kind, all(c.free for c in cells))
    if any(isinstance(v, Tables) for v in values):
        return Tables([x for v in values for x in (v.items if isinstance(v, Tables) else [v])])
    return table_of(_union([_whole(a, v).df for v in values]))


def _union(tables: list[DataFrame]) -> DataFrame:
    """Tables one after the other, with columns of one type."""
    tables = [t for t in tables if t.columns] or tables[:1]
    if len({tuple(t.dtypes) for t in tables}) == 1:
        return reshape.concat(*tables)
    kind = common_type([t.schema for t in tables])
    return reshape.concat(*[t.select(*[cast_to(Cell(F.col(f"`{f.name}`"), t.schema[f.name].dataType), f.dataType).alias(f.name) for f in kind.fields if f.name in t.columns]) for t in tables])


@builtin("flatten", 1, MANY, ("subshard",))
def _flatten(a: Arguments) -> Any:
    parts: list[DataFrame] = []
    for i in range(len(a)):
        v = a.value(i)
        if isinstance(v, Tables):
            if len(v.items) == 1 and isinstance(v.items[0], Tables):
                return v.items[0]
            parts += [_whole(a, x).df for x in v.items]
        elif _is_cell_table(v) and not v.free:
            items, kind = _items(v)
            return Cell(F.flatten(items), kind)
        else:
            parts.append(reshape.flatten(_whole(a, v).df))
    return table_of(_union(parts)) if parts else BUILTINS["table"](Arguments(a.engine, "table", s.Call(s.Var("table"), ()), {}))


def _names_from(a: Arguments, first: int) -> list[str]:
    return [a.constant(i) for i in range(first, len(a))]


@builtin("gather", 2, MANY, ("key", "value"))
def _gather(a: Arguments) -> Any:
    v, columns, key, value = a.value(0), _names_from(a, 1), a.constant("key"), a.constant("value")
    if _is_cell_table(v) and not v.free:
        items, kind = _items(v)
        made, of = reshape.gather_cell(items, kind, columns, key, value)
        return Cell(made, T.ArrayType(of))
    return table_of(reshape.gather(_whole(a, v).df, columns, key, value))


@builtin("spread", 1, 1, ("key", "value"))
def _spread(a: Arguments) -> Table:
    return table_of(reshape.spread(_whole(a, a.value(0)).df, a.constant("key"), a.constant("value")))


@builtin("collapse", 2, MANY)
def _collapse(a: Arguments) -> Any:
    v, columns = a.value(0), _names_from(a, 1)
    if _is_cell_table(v) and not v.free:
        items, kind = _items(v)
        made, of = reshape.collapse_cell(items, kind, columns)
        return Cell(made, T.ArrayType(of))
    return table_of(collapse.collapse(_whole(a, v).df, columns))


@builtin("transpose", 3, 3, ("row",))
def _transpose(a: Arguments) -> Table:
    df = _whole(a, a.value(0)).df
    if len(df.columns) != 2:
        raise EvalProblem("transpose takes a table of two columns")
    keys, cells = df.columns
    key = a.per_row(1, row_of(df))
    if fields_of(key) is None:
        raise EvalProblem("the key of transpose is a struct")
    kind = df.schema[cells].dataType.elementType

    def entry(x: Column) -> tuple[Column, Column]:
        v = a.engine.eval(a.nodes[2], a.scope | {_ROW: Cell(x, kind), _INNER: Cell(x, kind)})
        if isinstance(v, (Function, Builtin)):
            v = a.engine.apply(v, [key, Cell(x, kind)] if len(getattr(v, "params", ())) == 2 else [Cell(x, kind)])
        *names, value = [to_cell(c) for c in fields_of(v).values()]
        return F.concat_ws("_", *[scalar.to_string(n.col, n.type) for n in names]), value.col

    return table_of(reshape.transpose(df, to_cell(key).col, cells, entry))


# ---------------------------------------------------------------- files and display


@builtin("read", 1, 1, ("type",))
def _read(a: Arguments) -> Table:
    path, form = a.constant(0), a.constant("type")
    found = registry.find(path, form)
    return Table(lambda: found.read(a.engine.spark, path), attrs={"name": found.name, "path": str(Path(path).absolute()) if "://" not in path else path})


@builtin("readdir", 1)
def _readdir(a: Arguments) -> Row:
    return Row({n: literal(p) for n, p in registry.list_files(a.engine.spark, a.constant(0)).items()})


@builtin("write", 2, 2, ("shards", "type"))
def _write(a: Arguments) -> Cell:
    t = _whole(a, a.value(0))
    return literal(registry.write(t.df, a.constant(1), a.constant("type"), a.constant("shards"), a.engine.overwrite))


@builtin("writecols", 2, 2, ("gzip",))
def _writecols(a: Arguments) -> Cell:
    from millrace.sources.tsv import write_columns

    write_columns(_whole(a, a.value(0)).df, a.constant(1), a.constant("gzip", False))
    return literal(True)


@builtin("force", 1)
def _force(a: Arguments) -> Any:
    """Keep a table for later uses, on disk where memory is short. The rows don't change."""
    from pyspark import StorageLevel

    v = a.value(0)
    if isinstance(v, Table):
        return Table(lambda: v.df.persist(StorageLevel.MEMORY_AND_DISK), v.cell, v.attrs)
    return v


@builtin("table_attrs", 1)
def _table_attrs(a: Arguments) -> Row:
    attrs = _whole(a, a.value(0)).attrs
    return Row({"name": literal(attrs.get("name", "")), "path": literal(attrs.get("path", ""))})


def text_of(v: Any, depth: int = 9) -> str:
    """A Python value in the language's notation."""
    from pyspark.sql import Row as SparkRow

    if v is None:
        return "NA"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, SparkRow):
        return "{" + ",".join(f"{n}:{text_of(x, depth - 1)}" for n, x in v.asDict().items()) + "}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(text_of(x, depth - 1) for x in v) + "]" if depth > 0 else "[omitted]"
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e21:
        return str(int(v))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def table_lines(df: DataFrame, depth: int = 9) -> Iterator[str]:
    """All rows of a table in the language's notation, fetched one partition after the other."""
    for r in df.toLocalIterator(prefetchPartitions=True):
        yield text_of(r[0] if df.columns == [VALUE] else r, depth)


def table_text(df: DataFrame, depth: int = 9) -> list[str]:
    """As :func:`table_lines`, for a table that the driver may hold."""
    return [text_of(r[0] if df.columns == [VALUE] else r, depth) for r in df.collect()]


@builtin("print", 1, MANY, ("depth", "mode"))
def _print(a: Arguments) -> Cell:
    """Every row of a table goes to the engine's ``out``."""
    mode, depth = a.constant("mode", "default"), a.constant("depth", 9)
    for i in range(len(a)):
        v = a.value(i)
        if isinstance(v, Table):
            lines = [v.df.schema.simpleString()] if mode == "description" else table_lines(v.df, depth)
        else:
            lines = [kind_name(v)] if mode == "description" else [text_of(a.engine.outside(v), depth)]
        for line in lines:
            a.engine.out(line)
    return literal(True)
