"""Separation of lines that fail to parse from typed rows, with the reason of each failure."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tsv import NA_SPELLINGS

#: How a kind of column reads: the Spark type and the pattern a cell must match as a whole. ``\z``, unlike ``$``, isn't satisfied before a final line break.
KINDS = {
    "int": ("bigint", r"\A[0-9]+\z"),
    "double": ("double", r"\A-?[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?\z"),
    "bool": ("boolean", r"\A(?:[tT][rR][uU][eE]|[fF][aA][lL][sS][eE])\z"),
    "sample": ("string", r"\AP[A-Z0-9]{6}\z"),
    "name": ("string", r"\A(?s:.+)\z"),
    "any": ("string", r"\A(?s:.*)\z"),
}


@dataclass(frozen=True)
class Rule:
    """What a column holds: its kind, and whether a missing value is allowed."""

    column: str
    kind: str
    nullable: bool = True


def reads_as(kind: Column, cell: Column) -> Column:
    """Whether the cell (spaces around it removed) reads as the kind. Never null for a cell that isn't null."""
    digits = F.regexp_replace(cell, r"\A0+(?=[0-9])", "")
    most = F.lit(str(2**63 - 1))
    fits = (F.length(cell) < 19) | (F.length(digits) < 19) | ((F.length(digits) == 19) & (digits <= most))
    out = F.when(kind == "int", cell.rlike(KINDS["int"][1]) & fits)
    for k in ("double", "bool", "sample", "name"):
        out = out.when(kind == k, cell.rlike(KINDS[k][1]))
    return out.otherwise(F.lit(True))


def _fields(line: Column, most: int) -> Column:
    """The fields of a line without their quotes; null if the quoting is broken.

    A field that begins with a quote runs to the next quote that isn't doubled, over tabs and line
    breaks. The pieces between tabs are folded: with doubled quotes taken out, a piece goes on if no quote is left, closes if the only one
    left is its last character, and is broken otherwise. Lines without a quote at the beginning of a field,
    nearly all, are only split. The fold keeps the first ``most + 1`` fields: more are an error anyway,
    and a long broken line then costs time in proportion to its length.
    """
    pieces = F.split(line, "\t", -1)
    init = F.struct(F.lit(False).alias("open"), F.lit(False).alias("bad"), F.lit(1).alias("at"), F.expr("cast(array() as array<int>)").alias("starts"))

    def step(a: Column, p: Column) -> Column:
        quoted = a["open"] | p.startswith('"')
        rest = F.replace(F.when(a["open"], p).otherwise(F.substring(p, 2, 2**31 - 1)), F.lit('""'), F.lit(""))
        quote = F.locate('"', rest)
        starts = F.when(~a["open"] & (F.size(a["starts"]) <= most), F.concat(a["starts"], F.array(a["at"]))).otherwise(a["starts"])
        return F.struct(
            (quoted & (quote == 0)).alias("open"),
            (a["bad"] | (quoted & (quote > 0) & (quote < F.length(rest)))).alias("bad"),
            (a["at"] + 1).alias("at"),
            starts.alias("starts"),
        )

    def cut(a: Column) -> Column:
        def field(s: Column, i: Column) -> Column:
            return _unquoted(F.array_join(F.slice(pieces, s, F.coalesce(F.get(a["starts"], i + 1), F.size(pieces) + 1) - s), "\t"))

        return F.when(~a["bad"] & ~a["open"], F.transform(a["starts"], field))

    return F.when(line.rlike(r'(?:\A|\t)"'), F.aggregate(pieces, init, step, cut)).otherwise(pieces)


def _unquoted(field: Column) -> Column:
    inner = F.replace(F.substr(field, F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))
    return F.when(field.startswith('"'), inner).otherwise(field)


class ParsedLines:
    """The result of :func:`parse_lines`."""

    def __init__(self, lines: DataFrame, rejected: DataFrame, rules: dict[str, list[Rule]]) -> None:
        self._lines, self.rejected, self._rules = lines, rejected, rules

    def typed(self, table: str) -> DataFrame:
        """The valid lines of a table: the id column, then the columns of the table with their types.

        Clean lines are those without a row among the rejected ones (an anti-join on the id and two 64-bit hashes of the whole line). Missing values are null.
        """
        rules = self._rules[table]
        good = self._lines.where((F.col("_table") == table) & F.col("_early").isNull())
        bad = self.rejected.where(F.col("reason") == "value").select(F.col("row_key").alias("_bad"), F.col("line_id").alias("_bad_id"))
        good = good.join(bad, (F.col("_key") == F.col("_bad")) & F.col("_id").eqNullSafe(F.col("_bad_id")), "left_anti")
        out = [F.col("_id").alias("line_id")]
        for i, r in enumerate(rules):
            cell = F.btrim(F.get("_cells", F.lit(i)))
            value = F.when(cell.isin(*NA_SPELLINGS), F.lit(None)).otherwise(cell) if r.nullable else cell
            kind = KINDS[r.kind][0]
            out.append((value if kind == "string" else value.try_cast(kind)).alias(r.column))
        return good.select(*out)


def parse_lines(df: DataFrame, rules: dict[str, list[Rule]], id_col: str, table_col: str, line_col: str, skip: Column | None = None) -> ParsedLines:
    """Split tab-separated lines into valid typed rows and rejected lines.

    ``rules`` names the columns of each table. Cells are exploded to (line, position, value), joined with the
    rule table, checked, and the errors are aggregated by line; clean lines remain by an anti-join.
    ``rejected`` has ``line_id``, ``reason``, ``first_column`` and ``n_errors`` (of value errors) and an
    internal ``row_key``. The first reason that holds counts: ``quoting``, ``column_count``, ``value``;
    lines of a table without rules, or null, get ``unknown_table``.

    Only failing cells are shuffled. The rule table has one row for each column, so it is broadcast.

    Defined cases: null, empty and blank lines, comments (``#`` first) and lines for which ``skip`` holds are neither typed nor
    rejected; null or repeated ids are fine (a line is told by id, table and text together); one trailing carriage return belongs
    to the line end; an empty table gives empty results; other columns are ignored.
    """
    spark: SparkSession = df.sparkSession
    most = max(len(r) for r in rules.values())
    src = df.where(~F.coalesce(skip, F.lit(False))) if skip is not None else df
    src = src.select(src[id_col].alias("_id"), src[table_col].cast("string").alias("_table"), F.regexp_replace(src[line_col], r"\r\z", "").alias("_line"))
    src = src.where(F.col("_line").rlike(r"\A(?!#)(?s:.*)[^ ]"))
    key = F.struct(F.xxhash64("_id", "_table", "_line").alias("a"), F.xxhash64(F.lit("check"), "_table", "_line").alias("b"))
    parsed = F.struct("_id", "_table", key.alias("_key"), _fields(F.col("_line"), most).alias("_cells"))
    # One row is exploded to one row: filters aren't pushed below this, so a line is split once and not for every use of its cells.
    src = src.select(F.inline(F.array(parsed)))
    width = F.lit(None).cast("int")
    for table, columns in rules.items():
        width = F.when(F.col("_table") == table, len(columns)).otherwise(width)
    early = F.when(width.isNull(), "unknown_table").when(F.col("_cells").isNull(), "quoting").when(F.size("_cells") != width, "column_count")
    lines = src.withColumn("_early", early)

    table = [(t, i, r.column, r.kind, r.nullable) for t, columns in rules.items() for i, r in enumerate(columns)]
    rule_table = spark.createDataFrame(table, "_table string, _pos int, _column string, _kind string, _nullable boolean")
    # Lines that can't be cut into the right number of cells have no cells to explode: one row without a position each.
    exploded = lines.select("_id", "_table", "_key", "_early", F.posexplode_outer(F.when(F.col("_early").isNull(), F.col("_cells"))).alias("_pos", "_cell"))
    cell = F.btrim("_cell")
    valid = reads_as(F.col("_kind"), cell) | (F.col("_nullable") & cell.isin(*NA_SPELLINGS))
    checked = exploded.join(F.broadcast(rule_table), ["_table", "_pos"], "left").where(F.col("_early").isNotNull() | ~valid)
    errors = checked.groupBy("_key", "_id", "_early").agg(
        F.min_by("_column", "_pos").alias("first_column"), F.size(F.collect_set("_pos")).alias("n_errors"), F.count("*").alias("_failed")
    )
    # A line that is repeated as a whole, id included, fails once for each copy: one rejected row for each, too.
    copies = F.array_repeat(F.lit(1), (F.col("_failed") / F.greatest("n_errors", F.lit(1))).cast("int"))
    rejected = errors.withColumn("_copy", F.explode(copies)).select(
        F.col("_id").alias("line_id"), F.coalesce("_early", F.lit("value")).alias("reason"), "first_column", "n_errors", F.col("_key").alias("row_key")
    )
    return ParsedLines(lines, rejected, rules)


def lab_rules() -> dict[str, list[Rule]]:
    """The rules of the two tables in ``raw_lines``."""
    # The columns of the two tables in order.
    bins = [
        Rule("chrom", "name", False), Rule("start", "int", False), Rule("end", "int", False),
        Rule("gc", "int"), Rule("count", "int"), Rule("length", "int"), Rule("density", "double"),
    ]
    runs = [
        Rule("sample", "sample", False), Rule("conta_call", "bool"), Rule("cf", "double"), Rule("sum_log_lr", "double"),
        Rule("avg_log_lr", "double"), Rule("snps", "int"), Rule("depth", "int"), Rule("pos_lr_all", "double"),
        Rule("pos_lr_x", "double"), Rule("pos_lr_chr_cv", "double"), Rule("y_count", "double"), Rule("pregnancy", "any"),
        Rule("excluded_regions", "int"), Rule("error_rate", "double"),
    ]
    changes = "T>A G>A C>A A>T G>T C>T A>G T>G C>G A>C T>C G>C"
    return {"small": bins, "conta": runs + [Rule(c, "double") for c in changes.split()]}
