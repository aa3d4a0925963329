"""Programs of the language over streams.

The language's ``map``, ``filter``, ``concat``, ``joinbed`` and joins with tables that aren't streams, and ``reduce`` with a native fold, are plain
DataFrame operations, so they run over a stream as over a table; what needs the order of a whole table (``sort``, ``firstn``, ``collapse``) doesn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.groups import NATIVE
from millrace.plans.engine import Engine


def over_stream(engine: Engine, name: str, stream: DataFrame, program: str) -> DataFrame:
    """The stream that a program makes of the stream ``name``."""
    if not stream.isStreaming:
        raise ValueError(f"{name} isn't a stream")
    engine.set_global(name, stream)
    out = engine.eval_text(program)
    if not isinstance(out, DataFrame) or not out.isStreaming:
        raise ValueError("the program doesn't make a stream of it")
    return out


def fold_windows(stream: DataFrame, time: str, width: str, key: Column, value: Column, how: str, late: str, slide: str | None = None) -> DataFrame:
    """Fold the values of each key and window of time: ``window_start``, ``key``, ``value``.

    Rows later than ``late`` behind the newest time seen are dropped, and the state of a window is dropped once it is complete.
    """
    window = F.window(time, width, slide) if slide else F.window(time, width)
    rows = stream.withWatermark(time, late).select(window.alias("w"), key.alias("key"), value.alias("value"))
    return rows.groupBy("w", "key").agg(NATIVE[how](F.col("value")).alias("value")).select(F.col("w.start").alias("window_start"), "key", "value")


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run what is available into the in-memory table ``name``, then stop. For tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
