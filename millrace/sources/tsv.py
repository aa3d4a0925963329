"""Tab-separated tables: types by vote of the first rows, and writers."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.scalar import float_text, to_string

# The spellings of a missing value.
NA_SPELLINGS = ("", "NA", "#N/A", "#N/A N/A", "#NA", "N/A", "NULL", "NaN", "nan", "-NaN", "-nan", "-1.#IND", "-1.#QNAN")
#: Rows that vote on the types of columns; a type that leads by LEAD votes is decided.
SAMPLE, LEAD = 65_536, 64

_INT = re.compile(r"[+-]?(?:0[xX][0-9a-fA-F]+|0[bB][01]+|0[oO]?[0-7]*|[1-9][0-9]*)")
_FLOAT = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?(?:inf|infinity)", re.I)
_TRUE, _FALSE = ("true", "1", "t", "y", "yes"), ("false", "0", "f", "n", "no")


def _votes_for(cell: str) -> str | None:
    if cell in NA_SPELLINGS:
        return None
    if _INT.fullmatch(cell):
        return "int"
    if _FLOAT.fullmatch(cell):
        return "float"
    return "bool" if cell.lower() in ("true", "false") else "string"


def vote(cells: list[str | None]) -> str:
    """The type of a column: ``string``, ``float``, ``int`` or ``bool``, by majority; missing cells don't vote, and without a vote it is a string."""
    counts: Counter = Counter()
    for cell in cells:
        kind = _votes_for(cell or "")
        if kind is None:
            continue
        counts[kind] += 1
        first, second = [*(n for _, n in counts.most_common(2)), 0][:2]
        if first - second >= LEAD:
            break
    return max(("string", "float", "int", "bool"), key=lambda k: counts[k])


def _typed(cell: Column, kind: str) -> Column:
    value = F.when(~cell.isin(*NA_SPELLINGS), cell)
    if kind == "string":
        return value
    if kind == "float":
        return value.cast("double")
    if kind == "bool":
        low = F.lower(value)
        return F.when(low.isin(*_TRUE), True).when(low.isin(*_FALSE), False).when(value.isNotNull(), F.raise_error(F.concat(F.lit("not a boolean: "), value)).cast("boolean"))
    sign = F.when(value.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(value, r"^[+-]", "")
    whole = F.when(digits.rlike(r"^[1-9][0-9]*$|^0$"), value.cast("long"))
    whole = whole.when(digits.rlike(r"^0[xX]"), sign * F.conv(F.substring(digits, 3, 30), 16, 10).cast("long"))
    whole = whole.when(digits.rlike(r"^0[oO]?[0-7]+$"), sign * F.conv(F.regexp_replace(digits, r"^0[oO]?", ""), 8, 10).cast("long"))
    whole = whole.when(digits.rlike(r"^0[bB]"), sign * F.conv(F.substring(digits, 3, 70), 2, 10).cast("long"))
    return whole.otherwise(value.cast("double").cast("long"))  # a stray float is truncated, a stray text is an error


def _raw(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".zst"):
        return _raw_zst(spark, path)
    try:
        return spark.read.csv(path, sep="\t", header=True, comment="#", inferSchema=False, mode="FAILFAST", quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    except Exception as e:  # an empty file has no header to read
        if "UNABLE_TO_INFER_SCHEMA" in str(e):
            return spark.createDataFrame([], "dummycol string")
        raise


def local_or_remote(path: str):  # noqa: ANN201
    """A file system of Arrow and the path in it, for readers that run in Python workers."""
    from urllib.parse import quote

    from pyarrow.fs import FileSystem, LocalFileSystem

    if path.startswith("file:") or "://" not in path:
        return LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return FileSystem.from_uri(quote(path, safe=":/@%"))


def _zst_records(batches):  # noqa: ANN001, ANN202
    """The records of each file as lists of cells, the file's header first. A file is decompressed as a stream; quoted cells may hold line breaks."""
    import csv
    import io
    import sys

    import pandas as pd

    csv.field_size_limit(sys.maxsize)
    for pdf in batches:
        for path in pdf["path"]:
            files, at = local_or_remote(path)
            with files.open_input_stream(at, compression="zstd") as raw:
                text = io.TextIOWrapper(raw, "utf-8", newline="")
                fresh = [True]

                def lines():  # noqa: ANN202
                    # Notes and blank lines are left out between records, not within a quoted cell.
                    for line in text:
                        if not fresh[0] or line.strip("\r\n ") and not line.startswith("#"):
                            fresh[0] = False
                            yield line

                cells, first = [], True
                for record in csv.reader(lines(), delimiter="\t"):
                    fresh[0] = True
                    cells.append((first, record))
                    first = False
                    if len(cells) == 10_000:
                        yield pd.DataFrame(cells, columns=["head", "cells"])
                        cells = []
                if cells:
                    yield pd.DataFrame(cells, columns=["head", "cells"])


def _raw_zst(spark: SparkSession, path: str) -> DataFrame:
    """Files compressed with zstandard, for which Hadoop may lack a codec: each is read as a stream by one Python worker. All files have the same header."""
    found = spark.read.format("binaryFile").load(path).select("path")
    records = found.mapInPandas(_zst_records, "head boolean, cells array<string>")
    head = records.where("head").first()
    if head is None:
        return spark.createDataFrame([], "dummycol string")
    names = head["cells"]
    header = F.array(*[F.lit(n) for n in names])
    wrong = F.raise_error(F.concat(F.lit("malformed record: "), F.array_join("cells", "\t", "")))
    fits = F.when(F.when(F.col("head"), F.col("cells") == header).otherwise(F.size("cells") == len(names)), F.col("cells")).otherwise(wrong.cast("array<string>"))
    # The check is a column of its own in front of the filter, so that it isn't skipped where no cell is asked for.
    body = records.select("head", fits.alias("cells")).where(~F.col("head") & F.col("cells").isNotNull())
    return body.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_tsv(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    """A table with a header row; rows that begin with ``#`` and blank rows are skipped. ``.gz``, ``.bz2`` and ``.zst`` are decompressed.

    The types are voted by the first SAMPLE rows, unless ``types`` (``string``, ``float``, ``int``, ``bool``) gives them, which saves the pass. A row with another number of cells is an
    error; dates stay strings.
    """
    raw = _raw(spark, path)
    if types is None:
        head = raw.limit(SAMPLE).collect()
        types = {c: vote([r[i] for r in head]) for i, c in enumerate(raw.columns)}
    return raw.select(*[_typed(F.coalesce(F.col(f"`{c}`"), F.lit("")), types.get(c, "string")).alias(c) for c in raw.columns])


def cell_text(x: Column, t: T.DataType) -> Column:
    """How a value is written: missing as ``NA``, tabs and line breaks as spaces."""
    if isinstance(t, (T.IntegralType, T.BooleanType, T.DateType)):
        return F.coalesce(x.cast("string"), F.lit("NA"))
    if isinstance(t, T.FractionalType):
        return F.coalesce(float_text(x), F.lit("NA"))
    if isinstance(t, (T.ArrayType, T.StructType, T.MapType)):
        x, t = F.to_json(x), T.StringType()
    return F.translate(F.when(x.isNull(), "NA").otherwise(to_string(x, t)), "\t\r\n", "   ")


def write_tsv(df: DataFrame, path: str, mode: str, shards: int | None = None, header: bool = True) -> None:
    """Write into the folder ``path``: a file for each partition of the table, in its order and without a shuffle, or ``shards`` files."""
    src = df if shards is None else df.repartition(shards)  # before cells become text, which is wider
    text = src.select(*[cell_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
    if not df.columns:
        text = df.sparkSession.createDataFrame([], "dummycol string")
    text.write.mode(mode).csv(path, sep="\t", header=header, quote="", emptyValue="", nullValue="NA", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


# The columns of a BED file.
BED = {"chrom": "string", "start": "int", "end": "int", "featname": "string"}


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """A BED file: no header; files of three columns have a missing ``featname``. Further columns are dropped.

    Cells read as in other tables: the spellings of a missing value are missing, and a bound that isn't a number is an error.
    """
    raw = spark.read.csv(path, sep="\t", schema=", ".join(f"{c} string" for c in BED), comment="#", mode="PERMISSIVE", quote='"', escape='"')
    return raw.select(*[_typed(F.coalesce(F.col(c), F.lit("")), kind).alias(c) for c, kind in BED.items()])


def write_columns(df: DataFrame, template: str, gzip: bool = False, mode: str = "overwrite") -> list[str]:
    """One table of a single column for each column. ``template`` is a path with ``{{.Name}}`` or ``{{.Number}}`` (from 0). Gives the paths.

    Each is a folder with a file for each partition of the table, so no column meets in one task. The table is cached for the passes over its columns.
    """
    if not re.search(r"\{\{\s*\.(Name|Number)\s*\}\}", template):
        raise ValueError("the path needs {{.Name}} or {{.Number}}")
    cached, paths = df.persist(), []
    try:
        for i, f in enumerate(df.schema.fields):
            name = re.sub(r"\s", "_", f.name)
            path = re.sub(r"\{\{\s*\.Name\s*\}\}", lambda _: name, template)
            path = re.sub(r"\{\{\s*\.Number\s*\}\}", str(i), path) + ".gz" * gzip
            text = cached.select(cell_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name))
            text.write.mode(mode).csv(path, sep="\t", header=True, quote="", emptyValue="", nullValue="NA", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, compression="gzip" if gzip else "none")
            paths.append(path)
    finally:
        cached.unpersist()
    return paths
