"""The N highest-scoring items of every group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import ScratchTable, cut

#: Relative rank error of the band limits is its inverse; the limits only balance work, the result is exact.
BAND_ACCURACY = 1_000
#: About what a row of one text takes in a broadcast hash relation besides the text: key and value rows, their record, and its places in the index.
RELATION_BYTES = 160


def top_items(
    df: DataFrame, group: str, score: str, tie: str, n: int, shares: tuple[float, ...] = (1 / 64, 1 / 16, 1 / 4), broadcast_bytes: int = 1_000_000
) -> DataFrame:
    """Rank the ``n`` highest scores of each group: ``group``, ``rank_no`` from 1, ``tie`` and ``score``.

    Equal scores are ranked by the smaller ``tie``. The scores are range-partitioned into descending bands: the top band holds about the first
    of ``shares`` of all rows, the last the rest. The bands are written once, without a shuffle, and processed from the top:

    * groups already filled are dropped by an anti-join before any sorting: all of them where they take at most ``broadcast_bytes`` (measured first), else as
      many of those with the most rows as do; the rest, small groups then, is dropped after the trim below, partitioned by group on both sides;
    * what remains of a band is ranked exactly by (score, tie) and trimmed to ``n`` rows a group in each task before the shuffle
      (Spark's window group limit), so a group with a third of all rows never meets in one task;
    * ranks continue after the rows that the group has from higher bands; a group fills up in its boundary band.

    Only band limits and counts of groups reach the driver. Each band's winners are checkpointed, so a lost executor costs one band at most.

    Defined cases: rows with a null group, a null or NaN score or a null tie don't take part; infinite scores do; -0.0 equals 0.0; rows repeated with
    the same tie all count; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    if n < 1:
        raise ValueError("n is at least 1")
    value = F.when(df[score] == 0, F.lit(0).cast(df.schema[score].dataType)).otherwise(df[score])
    rows = df.select(df[group].alias("_g"), value.alias("_x"), df[tie].alias("_t"))
    rows = rows.where(F.col("_g").isNotNull() & F.col("_t").isNotNull() & F.col("_x").isNotNull())
    if df.schema[score].dataType.typeName() in ("double", "float"):
        rows = rows.where(~F.isnan("_x"))
    wanted = F.array(*[F.lit(1 - s) for s in shares])
    limits = sorted({x for x in rows.agg(F.percentile_approx("_x", wanted, BAND_ACCURACY)).first()[0] or ()}, reverse=True)
    band = reduce(lambda a, b: a + b, [F.when(F.col("_x") < x, 1).otherwise(0) for x in limits], F.lit(0))
    order = [F.col("_x").desc(), F.col("_t").asc()]
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))

    def trimmed(part: DataFrame) -> DataFrame:
        if n > limit:  # beyond Spark's own trim: first by group and a salt, so that no task gets a whole group
            salted = Window.partitionBy("_g", F.pmod(F.xxhash64("_t", "_x"), F.lit(1024))).orderBy(*order)
            part = part.withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= n)
        return part.withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy(*order))).where(F.col("_r") <= n)

    bands = ScratchTable(rows.withColumn("_band", band.cast("int")), ("_band",))
    kept: list[DataFrame] = []
    try:
        have: DataFrame | None = None
        sizes: DataFrame | None = None
        for b in range(len(limits) + 1):
            part = bands.read().where(F.col("_band") == b).drop("_band")
            if have is None:
                top = trimmed(part).withColumn("rank_no", F.col("_r"))
            else:
                filled = have.where(F.col("_have") >= n).select("_g")
                each = F.octet_length(F.col("_g").cast("string")) + RELATION_BYTES
                size, longest = filled.agg(F.sum(each), F.max(each)).first()
                if (size or 0) <= broadcast_bytes:
                    top = trimmed(part.join(F.broadcast(filled), "_g", "left_anti"))
                else:
                    if sizes is None:
                        sizes = cut(bands.read().groupBy("_g").agg(F.count("*").alias("_rows")))
                    large = filled.join(sizes, "_g").orderBy(F.col("_rows").desc()).limit(broadcast_bytes // longest).select("_g")
                    top = trimmed(part.join(F.broadcast(large), "_g", "left_anti")).join(filled, "_g", "left_anti")
                top = top.join(have, "_g", "left").withColumn("rank_no", F.col("_r") + F.coalesce("_have", F.lit(0))).where(F.col("rank_no") <= n)
            kept.append(cut(top.select("_g", F.col("rank_no").cast("int").alias("rank_no"), "_t", "_x")))
            have = reduce(DataFrame.unionByName, kept).groupBy("_g").agg(F.max("rank_no").alias("_have"))
    finally:
        bands.drop()
    out = reduce(DataFrame.unionByName, kept)
    return out.select(F.col("_g").alias(group), "rank_no", F.col("_t").alias(tie), F.col("_x").alias(score))
