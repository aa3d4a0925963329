"""Continuous periods and gaps of intervals, for each entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str, bucket_bits: int = 22) -> DataFrame:
    """Merge half-open intervals ``[start, end)`` of each entity into periods and list the gaps between them.

    Overlapping, nested and touching intervals form one period. Returns the key columns, ``kind``
    (``period`` or ``gap``), ``span_start`` and ``span_end``.

    Sorted by start, an interval opens a new island where its start lies beyond the running maximum of
    the ends before it; a cumulative count of such openings labels the islands. So that one entity
    with a huge share of the rows isn't sorted in one task, the axis is cut into buckets of
    ``2 ** bucket_bits`` positions:

    * intervals of an entity with equal starts are reduced to the longest before anything is sorted, so
      a bucket never holds more rows than positions, and repeated rows cost nothing further on;
    * the running maximum enters a bucket as a carry, from one row for each bucket;
    * islands are labelled and reduced within their bucket; only the first and the last piece of a
      bucket can belong to an island of several buckets, and only these are labelled along the entity.

    Choose ``bucket_bits`` near half the bits of an entity's span (22 suits genome positions; 30 suits
    microseconds). A poor choice costs parallelism, never rows.

    Defined cases: intervals with a null key, a null bound or ``end <= start`` don't count; an empty
    table gives an empty table; bounds are read as long; other columns are ignored, whatever their names.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[df[k].alias(n) for k, n in zip(keys, names)], df[start].cast("long").alias("_s"), df[end].cast("long").alias("_e"))
    rows = rows.where(F.col("_e") > F.col("_s"))
    for n in names:
        rows = rows.where(F.col(n).isNotNull())
    # The join below infers this for one of its sides alone; stated here, both read the same exchange.
    rows = rows.where(F.shiftright("_s", bucket_bits).isNotNull())
    starts = rows.groupBy(*names, "_s").agg(F.max("_e").alias("_e")).withColumn("_b", F.shiftright("_s", bucket_bits))

    within = Window.partitionBy(*names, "_b").orderBy("_s")
    along = Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = starts.groupBy(*names, "_b").agg(F.max("_e").alias("_be")).select(*names, "_b", F.max("_be").over(along).alias("_carry"))
    seen = starts.withColumn("_prev", F.max("_e").over(within.rowsBetween(Window.unboundedPreceding, -1)))
    seen = seen.join(carry, [*names, "_b"]).withColumn("_before", F.greatest("_prev", "_carry"))
    opens = F.when(F.col("_before").isNull() | (F.col("_s") > F.col("_before")), 1).otherwise(0)
    labelled = seen.withColumn("_i", F.sum(opens).over(within.rowsBetween(Window.unboundedPreceding, 0)))

    pieces = labelled.groupBy(*names, "_b", "_i").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.min_by("_before", "_s").alias("_before"))
    # Piece 0 continues an island of an earlier bucket; the last piece may be continued in a later one.
    last = F.max("_i").over(Window.partitionBy(*names, "_b"))
    pieces = pieces.withColumn("_edge", (F.col("_i") == 0) | (F.col("_i") == last))
    pieces = pieces.withColumn("_own", F.when(~F.col("_edge"), F.struct("_b", "_i")))
    label = F.sum(F.when(F.col("_i") == 0, 0).otherwise(1)).over(Window.partitionBy(*names, "_own").orderBy("_b", "_i"))
    islands = (
        pieces.withColumn("_label", label)
        .groupBy(*names, "_own", "_label")
        .agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.min_by("_before", "_s").alias("_before"))
    )
    spans = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("_s").alias("span_start"), F.col("_e").alias("span_end")),
        F.struct(F.lit("gap").alias("kind"), F.col("_before").alias("span_start"), F.col("_s").alias("span_end")),
    )
    out = islands.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], F.explode(spans).alias("_x"))
    return out.select(*keys, "_x.kind", "_x.span_start", "_x.span_end").where(F.col("span_start").isNotNull())
