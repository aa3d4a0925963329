"""Percentiles of very large numeric columns by group, from sketches that can be stored and put together."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.rank_sketch import ColumnSketch, section_size

#: Bytes that a task holds in sketches, objects included, before it hands them on.
HELD = 64_000_000
#: Tasks that read a table, from which on their sketches are merged in two rounds: one takes a task a second or so for each key.
MANY = 10_000
#: Sketches in an output batch of a task.
BATCH = 2_000


def _schema(df: DataFrame, keys: list[str]) -> T.StructType:
    own = [("column_name", T.StringType()), ("n", T.LongType()), ("part", T.LongType()), ("sketch", T.BinaryType())]
    return T.StructType([*(df.schema[k] for k in keys), *(T.StructField(*x) for x in own)])


def _key(values: tuple) -> tuple:
    return tuple(None if x is None or x != x else x for x in values)


def _build(batches: Iterator[pd.DataFrame], keys: list[str], values: list[str], protect: str, k: int) -> Iterator[pd.DataFrame]:
    context = TaskContext.get()
    part = context.partitionId() << 20 if context else 0
    sketches: dict[tuple, ColumnSketch] = {}
    held = 0

    def flush() -> Iterator[pd.DataFrame]:
        while sketches:
            some = [sketches.popitem() for _ in range(min(BATCH, len(sketches)))]
            yield pd.DataFrame([(*key, s.n, part, s.to_bytes()) for key, s in some], columns=[*keys, "column_name", "n", "part", "sketch"])

    for pdf in batches:
        columns = {v: pdf[v].to_numpy(dtype=float, na_value=np.nan) for v in values}
        groups = pdf.groupby(keys, dropna=False, sort=False).indices if keys else {(): np.arange(len(pdf))}
        for key, at in groups.items():
            key = _key(key if isinstance(key, tuple) else (key,))
            for v in values:
                x = columns[v][at]
                x = x[~np.isnan(x)]
                if len(x):
                    s = sketches.get((*key, v))
                    if s is None:
                        s = sketches[*key, v] = ColumnSketch(k, protect)
                    else:
                        held -= s.held()
                    s.update(x)
                    held += s.held()
            if held > HELD:
                yield from flush()
                held, part = 0, part + 1
    yield from flush()


def _merge(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Merge neighbouring rows with equal keys; one sketch is held at a time, however many are merged."""
    columns = [*keys, "column_name", "n", "part", "sketch"]
    now, sketch, part, out = None, None, 0, []
    for pdf in batches:
        for *key, state, p in zip(*(pdf[c] for c in keys), pdf["column_name"], pdf["sketch"], pdf["part"]):
            key, other = _key(tuple(key)), ColumnSketch.from_bytes(state)
            if key == now:
                sketch.merge(other)
                continue
            if sketch is not None:
                out.append((*now, sketch.n, part, sketch.to_bytes()))
            now, sketch, part = key, other, p
        if len(out) >= BATCH:
            yield pd.DataFrame(out, columns=columns)
            out = []
    if sketch is not None:
        yield pd.DataFrame([*out, (*now, sketch.n, part, sketch.to_bytes())], columns=columns)


def merge_sketches(sketches: DataFrame, keys: list[str], many: bool = False, fan_in: int = 256) -> DataFrame:
    """Put sketches of days, files or partitions together: one for each of ``keys`` and column.

    ``many``: a key has sketches of so many partitions that one task shouldn't merge them one after the other; ``fan_in`` tasks for each key do so first.
    The order of merging follows the partitions that the sketches were made in, so a run over the same partitions gives the same result; over others it may differ, within the error.
    """
    names = [*keys, "column_name"]
    out = sketches.select(*names, "n", "part", "sketch")
    first = [F.shiftright("part", 20) % fan_in]
    for salt in [first, []] if many else [[]]:
        order = [*names, *salt, "part", "n", F.xxhash64("sketch")]
        out = out.repartition(*names, *salt).sortWithinPartitions(*order).mapInPandas(partial(_merge, keys=keys), _schema(sketches, keys))
    return out


def _scanned_parts(df: DataFrame) -> float:
    """About how many tasks read a table, by the size that the planner estimates; no job is run."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size / df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


def sketch_columns(df: DataFrame, keys: list[str], values: list[str], eps: float = 0.01, protect: str = "both") -> DataFrame:
    """Sketch numeric columns for each of ``keys``.

    One row for each key and column: the key columns, ``column_name``, ``n``, ``part`` (for the order of merging) and
    ``sketch`` (bytes that can be stored, and given to :func:`merge_sketches` and :func:`percentiles` later).

    Each task sketches its rows as it reads them, so sketches are shuffled, never rows; the size of one grows with the
    logarithm of its rows. ``protect`` is ``high`` or ``low``, the tail near which the error is least, or ``both``.

    Error, at three standard deviations: the rank of a value read at share ``s`` of ``n`` values is off by at most ``eps * n * (1 - s)`` on the protected
    high side, ``eps * n * s`` on the low side. Groups of a few hundred values are exact.

    Defined cases: null and NaN values are left out, infinite ones are values; null keys form a group; a key without a value has no
    sketch; values are read as double; an empty table gives no sketch; other columns are ignored, whatever their names.
    """
    src = df.select(*[df[k] for k in keys], *[df[v].cast("double").alias(v) for v in values])
    build = partial(_build, keys=keys, values=values, protect=protect, k=section_size(eps))
    return merge_sketches(src.mapInPandas(build, _schema(src, keys)), keys, many=_scanned_parts(src) > MANY)


def _read(batches: Iterator[pd.DataFrame], keys: list[str], shares: dict[str, float]) -> Iterator[pd.DataFrame]:
    names = [*keys, "column_name", "n"]
    for pdf in batches:
        found = pd.DataFrame([ColumnSketch.from_bytes(x).quantiles(list(shares.values())) for x in pdf["sketch"]], columns=list(shares), dtype=float)
        yield pd.concat([pdf[names].reset_index(drop=True), found], axis=1)


def percentiles(sketches: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """Read percentiles off sketches, of which there is one for each of ``keys``: the keys, ``column_name``, ``n`` and a column for each of ``shares``."""
    own = [T.StructField("column_name", T.StringType()), T.StructField("n", T.LongType()), *(T.StructField(s, T.DoubleType()) for s in shares)]
    return sketches.mapInPandas(partial(_read, keys=keys, shares=shares), T.StructType([*(sketches.schema[k] for k in keys), *own]))
