"""Formats by name or path."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from millrace.sources import bam, tsv


@dataclass(frozen=True)
class Format:
    name: str
    pattern: str
    read: Callable[[SparkSession, str], DataFrame]
    write: Callable[[DataFrame, str, str, int | None], None] | None = None


FORMATS: dict[str, Format] = {}


def register(name: str, pattern: str, read: Callable, write: Callable | None = None) -> None:
    """Add a format, or replace the one of this name. ``pattern`` is searched for in paths; the longest match decides."""
    FORMATS[name] = Format(name, pattern, read, write)


def find(path: str, name: str | None = None) -> Format:
    if name:
        if name not in FORMATS:
            raise ValueError(f"no such format: {name}")
        return FORMATS[name]
    found = [(len(m[0]), f.name) for f in FORMATS.values() if (m := re.search(f.pattern, path))]
    if not found:
        raise ValueError(f"no format is known for {path}; name one")
    return FORMATS[max(found)[1]]


def read(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    return find(path, name).read(spark, path)


def write(df: DataFrame, path: str, name: str | None = None, shards: int | None = None, overwrite: bool = False) -> bool:
    """Write a table, a file for each partition or ``shards`` files; what exists is left alone unless ``overwrite``. True in either case."""
    form = find(path, name)
    if form.write is None:
        raise ValueError(f"{form.name} can't be written")
    if not overwrite and exists(df.sparkSession, path):
        return True
    form.write(df, path, "overwrite" if overwrite else "error", shards)
    return True


def _folder(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _folder(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    """A file's text, from wherever Spark reads files."""
    found = spark.read.text(path if "://" in path or path.startswith("file:") else str(Path(path).absolute()), wholetext=True).first()
    return "" if found is None else found[0]


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file of its own, wherever Spark writes files."""
    p, fs = _folder(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def list_files(spark: SparkSession, path: str) -> dict[str, str]:
    """The files below a folder by a name made of their path: without the folder's own name, with ``_`` for slashes and dots."""
    p, fs = _folder(spark, path.rstrip("/"))
    root = fs.resolvePath(p).toString()
    own, out, walk = p.getName(), {}, fs.listFiles(p, True)
    while walk.hasNext():
        full = walk.next().getPath().toString()
        name = full[len(root) + 1 :]
        for end in "./_":
            name = name.replace(own + end, "")
        out[re.sub(r"[/.]", "_", name)] = full.removeprefix("file:")
    return dict(sorted(out.items(), key=lambda x: x[1]))


def _write_parquet(df: DataFrame, path: str, mode: str, shards: int | None) -> None:
    (df if shards is None else df.repartition(shards)).write.mode(mode).parquet(path)


register("tsv", r"\.tsv(?:\.gz|\.bz2|\.zst)?$", tsv.read_tsv, lambda df, path, mode, shards: tsv.write_tsv(df, path, mode, shards))
register("bed", r"\.bed(?:\.gz|\.bz2)?$|\.bed\.count$", tsv.read_bed, lambda df, path, mode, shards: tsv.write_tsv(df, path, mode, shards, header=False))
register("parquet", r"\.parquet/?$", lambda spark, path: spark.read.parquet(path), _write_parquet)
register("btsv", r"\.btsv/?$", lambda spark, path: spark.read.parquet(path), _write_parquet)
register("bam", r"\.bam$", bam.read_alignments)
