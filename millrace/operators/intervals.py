"""Join of rows with the features whose half-open interval overlaps theirs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.rows import expand, in_order, row_struct

#: Positions in a bin of the finest level, as bits, and by how many bits the bins of each further level are longer.
BIN_BITS, STEP_BITS = 17, 4
#: A row touches two bins of its level (of the coarsest, three); a feature 17, so that its bins aren't much longer than it is.
SLACK_BITS = 4
_MOST = 2**63 - 1


def _level(start: str, end: str, bits: int, slack: int) -> Column:
    """The finest level of which 2 ** slack bins are as long as the interval."""
    length = f"coalesce(try_subtract({end}, {start}), {_MOST}L)"
    return F.expr(" + ".join(f"int({length} > {1 << (b + slack)}L)" for b in range(bits, 63 - slack, STEP_BITS)))


def _span(level: str, start: str, end: str, bits: int) -> str:
    """The first and last bin that an interval touches on a level."""
    shift = f"int(least({level} * {STEP_BITS} + {bits}, 62))"
    return f"named_struct('l', {level}, 'i', shiftright({start}, {shift}), 'j', shiftright({end} - 1, {shift}))"


def overlap_join(
    rows: DataFrame,
    features: DataFrame,
    chrom: Column,
    start: Column,
    end: Column,
    output: Callable[[Column, Column], Column] | None = None,
    bits: int = BIN_BITS,
) -> DataFrame:
    """Rows whose interval ``[start, end)`` overlaps a feature's on the same chromosome.

    ``features`` has the columns chrom, start, end. Without ``output`` each row comes out once if it overlaps anything; with it, ``output(row, feature)`` for each
    overlap, equal outputs of one row once.

    Bins have levels: an interval belongs to the finest level at which it touches but a few, so it touches few however long it is. A pair meets on the coarser of its two levels.
    Rows are put in the bins of their own level and, marked, in those of the coarser levels that features have (a job over the features finds these, a dozen at most);
    features in those of their own level, for both kinds of rows, and of all coarser ones, for rows of that level. So the join is an equality of (chromosome, mark, level, bin), checked
    exactly, and counted only in the first bin that both share; Spark joins by hash, no row meets the features of a whole chromosome, and an interval of 2^62 positions costs no more
    than another. Spark broadcasts the features below its measured limit, else it splits bins with a great share of the rows (adaptive skew joins).

    Defined cases: null chromosomes or bounds, and intervals without a position (``end <= start``), overlap nothing; an empty side gives an empty table.
    """
    left = in_order(rows.select(row_struct(rows).alias("__r"), chrom.alias("__c"), start.cast("long").alias("__s"), end.cast("long").alias("__e")))
    right = features.select(row_struct(features).alias("__f"), F.col("chrom").alias("__fc"), F.col("start").cast("long").alias("__fs"), F.col("end").cast("long").alias("__fe"))
    right = right.where("__fe > __fs").withColumn("__fa", _level("__fs", "__fe", bits, SLACK_BITS))
    coarser = [x for x in sorted(r[0] for r in right.select("__fa").distinct().collect()) if x]
    left = left.where("__e > __s").withColumn("__a", _level("__s", "__e", bits, 0))
    own = _span("__a", "__s", "__e", bits)
    spans = ", ".join([own, *[f"if(__a < {x}, {_span(str(x), '__s', '__e', bits)}, null)" for x in coarser]])
    left = left.withColumn("__x", F.expr(f"explode(array_compact(array({spans})))" if coarser else own)).withColumn("__m", F.expr("__x.l > __a"))
    top = len(range(bits, 63, STEP_BITS))
    right = right.withColumn("__y", F.expr(f"explode(transform(sequence(__fa, {top}), x -> {_span('x', '__fs', '__fe', bits)}))"))
    right = right.withColumn("__fm", F.expr("explode(if(__y.l = __fa, array(false, true), array(false)))")).withColumn("__fb", F.expr("explode(sequence(__y.i, __y.j))"))
    same = F.expr("__c = __fc and __m = __fm and __x.l = __y.l and __b = __fb and __s < __fe and __fs < __e")
    if output is None:
        found = left.withColumn("__b", F.expr("explode(sequence(__x.i, __x.j))")).join(right.drop("__f"), same, "left_semi")
        return found.select("__row", "__r").dropDuplicates(["__row"]).select(F.col("__r").alias("_")).transform(expand)
    hits = left.withColumn("__b", F.expr("explode(sequence(__x.i, __x.j))")).join(right, same & F.expr("__b = greatest(__x.i, __y.i)"))
    made = hits.select("__row", output(F.col("__r"), F.col("__f")).alias("_")).dropDuplicates(["__row", "_"])
    return made.select("_").transform(expand)
