"""A mix of sources in target shares of its tokens, dealt to shards."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import cut

#: Blocks that a shard is dealt: a source's share of a shard is off by sqrt(share * (1 - share) / SHARD_BLOCKS) in the mean square, 0.008 at most. At most so many in all, which is what numpy's draws take.
SHARD_BLOCKS, MOST_BLOCKS = 4_096, 900_000_000
#: About so many records are in a bucket of places, within which tokens are summed up in order.
BUCKET_RECORDS = 512
#: Tokens of a shard, and the fewest shards, where their number isn't given.
SHARD_TOKENS, FEWEST_SHARDS = 50_000_000, 16
#: Partitions that shards are brought together in.
MOST_PARTITIONS = 10_000
#: Targets that are taken; the plan of a mix has a row for each and is made on the driver.
MOST_TARGETS = 10_000
#: Equal rows that are written out by one task.
COPIES = 10_000
#: Draws of the splitting tree that a task keeps.
KEPT_DRAWS = 2_000_000


@dataclass(frozen=True)
class _Quota:
    source: str
    share: float
    repeats: int
    records: int
    tokens: int
    rounds: int  # full rounds over all records
    rest: int  # tokens of one more, partial round


class SplittingTree:
    """Deals the blocks of sources to shards: a tree that splits the pool in halves.

    At each node the left half gets its exact share of the blocks, and how many of each source is drawn from the multivariate
    hypergeometric distribution, as if the blocks were shuffled together. A source's blocks are in random order beforehand, so the first ones go to the left. A draw depends on the seed and
    the node alone: any task finds the shard of a block by walking down, and nobody holds a list of blocks or shards.
    """

    def __init__(self, blocks: list[int], shards: int, seed: int) -> None:
        self.blocks, self.shards, self.seed = np.asarray(blocks, np.int64), shards, seed
        self._drawn: dict[tuple[int, int], np.ndarray] = {}

    def left(self, lo: int, hi: int, pool: np.ndarray) -> np.ndarray:
        """Blocks of each source that go to the left half of the shards from ``lo`` up to ``hi``."""
        drawn = self._drawn.get((lo, hi))
        if drawn is None:
            wanted = int(round(int(pool.sum()) * ((lo + hi) // 2 - lo) / (hi - lo)))
            drawn = np.random.default_rng([self.seed, lo, hi]).multivariate_hypergeometric(pool, wanted, method="marginals") if pool.sum() else pool
            if len(self._drawn) * (len(pool) + 16) >= KEPT_DRAWS:
                self._drawn.clear()
            self._drawn[lo, hi] = drawn
        return drawn

    def shards_of(self, source: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The shard of each block, given by the number of its source and its own."""
        out = np.zeros(len(source), np.int64)
        todo = [(0, self.shards, self.blocks, np.arange(len(source)), block)]
        while todo:
            lo, hi, pool, rows, at = todo.pop()
            if hi - lo == 1:
                out[rows] = lo
                continue
            mid, drawn = (lo + hi) // 2, self.left(lo, hi, pool)
            first = drawn[source[rows]]
            goes = at < first
            if goes.any():
                todo.append((lo, mid, drawn, rows[goes], at[goes]))
            if not goes.all():
                todo.append((mid, hi, pool - drawn, rows[~goes], (at - first)[~goes]))
        return out

    def table(self) -> np.ndarray:
        """Blocks of each source (columns) in each shard (rows)."""
        out = np.zeros((self.shards, len(self.blocks)), np.int64)
        todo = [(0, self.shards, self.blocks)]
        while todo:
            lo, hi, pool = todo.pop()
            if hi - lo == 1:
                out[lo] = pool
                continue
            drawn = self.left(lo, hi, pool)
            todo += [(lo, (lo + hi) // 2, drawn), ((lo + hi) // 2, hi, pool - drawn)]
        return out


def _dealt(batches: Iterator[pa.RecordBatch], blocks: list[int], shards: int, seed: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    tree = SplittingTree(blocks, shards, seed)
    for batch in batches:
        *rest, source, block = batch.columns
        shard = tree.shards_of(source.to_numpy(zero_copy_only=False), block.to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([*rest, pa.array(shard, pa.int32())], names=names)


def _numbered(rows: DataFrame) -> DataFrame:
    """Number equal rows from 0 in ``_copy``, so that each has a place of its own. Equal rows are counted and written out again, which is the same
    whatever the order and partitions of the rows; many of one kind are written by several tasks."""
    kind = ["_id", "_source", "_n"]
    same = rows.groupBy(*kind).agg(F.count("*").alias("_c"))
    few = same.where(F.col("_c") <= COPIES).select(*kind, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c") - 1)).alias("_copy"))
    parts = same.where(F.col("_c") > COPIES).select(*kind, "_c", F.explode(F.expr(f"sequence(0L, _c - 1, {COPIES}L)")).alias("_first")).repartition(*kind, "_first")
    many = parts.select(*kind, F.explode(F.sequence("_first", F.least(F.col("_first") + COPIES, "_c") - 1)).alias("_copy"))
    return few.unionByName(many)


def _order(seed: int, round_no: Column | int) -> Column:
    """The place of a record in the permutation of a round: 63 bits that depend on the record, the round and the seed. Records of equal ids differ by tokens or number."""
    return F.xxhash64("_id", "_n", "_copy", F.lit(seed), F.lit(round_no) if isinstance(round_no, int) else round_no).bitwiseAND(F.lit(2**63 - 1))


def _quotas(spark: SparkSession, sized: DataFrame, targets: list, total: int | None) -> list[_Quota]:
    have = {r["_source"]: r for r in sized.groupBy("_source").agg(F.count("*").alias("n"), F.sum("_n").alias("t")).collect()}
    live = [t for t in targets if t["source"] in have and have[t["source"]]["t"] > 0 and t["share"] > 0 and t["repeats"] > 0]
    if not live:
        return []
    whole = sum(t["share"] for t in live)
    most = min(t["repeats"] * have[t["source"]]["t"] * whole / t["share"] for t in live)
    size = most if total is None else min(most, total)
    out = []
    for t in live:
        n, tokens = have[t["source"]]["n"], have[t["source"]]["t"]
        want = min(int(size * t["share"] / whole + 1e-6), t["repeats"] * tokens)
        rounds, rest = divmod(want, tokens)
        out.append(_Quota(t["source"], t["share"], t["repeats"], n, tokens, rounds, rest))
    return out


def _taken(src: DataFrame, quotas: list[_Quota], seed: int) -> DataFrame:
    """The uses of records: ``_s`` (the number of the source), ``_round``, ``_place`` in the round's permutation and ``_start``, the tokens of the source's uses before it, all rounds in turn.

    The running sums are made in three steps, none of which sorts a source as a whole: of the buckets of places within 4,096 neighbours, of these neighbourhoods, and of the records of a bucket.
    Of a partial round, what lies beyond the neighbourhood in which the quota ends isn't shuffled.
    """
    rows = [(q.source, i, q.tokens, q.rounds, q.rest, max(0, int(q.records // BUCKET_RECORDS).bit_length())) for i, q in enumerate(quotas)]
    plan = src.sparkSession.createDataFrame(rows, "_source string, _s int, _tokens long, _rounds int, _rest long, _bits int")
    uses = src.join(F.broadcast(plan), "_source")  # at most MOST_TARGETS rows
    partial_round = uses.where("_rest > 0").select("_s", "_rest", F.shiftright(_order(seed, F.col("_rounds")), 51).alias("_far"), "_n")
    sums = partial_round.groupBy("_s", "_rest", "_far").agg(F.sum("_n").alias("_t"))
    before = F.coalesce(F.sum("_t").over(Window.partitionBy("_s").orderBy("_far").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = sums.withColumn("_before", before).where("_before < _rest").groupBy("_s").agg(F.max("_far").alias("_far"))
    uses = uses.join(F.broadcast(ends), "_s", "left")  # a row for each target at most
    uses = uses.withColumn("_round", F.explode(F.expr("sequence(0, if(_rest > 0, _rounds, _rounds - 1), 1)").cast("array<int>"))) if quotas else uses.withColumn("_round", F.lit(0))
    uses = uses.withColumn("_place", _order(seed, F.col("_round"))).where("_round < _rounds or shiftright(_place, 51) <= _far")
    uses = uses.withColumn("_bucket", F.expr("shiftright(_place, 63 - _bits)")).drop("_far", "_bits")

    bucket, near = ["_s", "_round", "_bucket"], ["_s", "_round", "_near"]
    sizes = uses.groupBy(*bucket).agg(F.sum("_n").alias("_t")).withColumn("_near", F.shiftright("_bucket", 12))
    upto = F.coalesce(F.sum("_t").over(Window.partitionBy(*near).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    far = sizes.groupBy(*near).agg(F.sum("_t").alias("_t"))
    upto_near = F.coalesce(F.sum("_t").over(Window.partitionBy("_s", "_round").orderBy("_near").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    far = far.select(*near, upto_near.alias("_upto_near"))
    offsets = sizes.select(*bucket, "_near", upto.alias("_upto")).join(far, near).select(*bucket, (F.col("_upto") + F.col("_upto_near")).alias("_offset"))
    within = Window.partitionBy(*bucket).orderBy("_place", "_n", "_copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = uses.join(offsets, bucket).withColumn("_in", F.col("_offset") + F.coalesce(F.sum("_n").over(within), F.lit(0)))
    return placed.where("_round < _rounds or _in + _n <= _rest").withColumn("_start", F.expr("_round * _tokens + _in"))


class Mix:
    """``draws``: one row for each use of a record. ``report``: shares reached, by source."""

    def __init__(self, draws: DataFrame, report: DataFrame) -> None:
        self.draws, self.report = draws, report


def mix_sources(
    df: DataFrame, record: str, source: str, tokens: str, targets: DataFrame, total_tokens: int | None = None, shards: int | None = None, seed: int = 7
) -> Mix:
    """Mix the records of several sources so that each gives its target share of the tokens.

    ``targets`` has ``source``, ``target_share`` and ``max_repeats``. The size is the largest at which no record is used more than ``max_repeats`` times and
    the shares still hold, or ``total_tokens`` if that is less. A source is used in whole rounds, then in a partial one over a random part of its records; a share
    misses its target by less than one record.

    There are ``shards``, or one for SHARD_TOKENS each. ``draws``: ``shard``, ``place`` (the order within a shard), the record's column, ``source``, ``round_no`` from 0, ``n_tokens``. ``report``: ``source``, ``target_share``,
    ``max_repeats``, ``records`` and ``tokens`` at hand, ``uses``, ``most_uses`` of one record, ``used_tokens``, ``actual_share`` and ``status``: ``mixed``, ``no records``
    (its share goes to the others in proportion) or ``no target`` (left out).

    The records of a round are permuted by a keyed hash, and the tokens of a source's uses are numbered along it and cut into blocks of equal tokens, SHARD_BLOCKS a shard. A splitting tree
    (:class:`SplittingTree`) deals exact numbers of blocks of each source to the shards, none twice; a record goes where the block goes in which it begins, and a shard is shuffled
    locally by hash. So shards have equal tokens, but for a record of each source at either end, and hold the mix: a source's share of a shard is off by 4 * sqrt(share * (1 - share) / SHARD_BLOCKS), 0.03 at most, in all but one of 10,000
    cases, and by those records. Shuffled are the records' ids and sizes: once to number equal rows, once to sum up tokens, once to bring shards together. The same seed gives the same mix.

    Defined cases: records of a null or untargeted source are left out and reported; null counts of tokens are 0; records without tokens may be drawn; null or repeated
    record ids are records of their own, each with its own place; an empty table gives no draws; source names are compared as they are.
    """
    spark = df.sparkSession
    wanted = targets.select(F.col("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("repeats")).where("source is not null").limit(MOST_TARGETS + 1).collect()
    if len(wanted) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    wanted = sorted(wanted)
    src = cut(_numbered(df.select(df[record].alias("_id"), df[source].alias("_source"), F.coalesce(df[tokens].cast("long"), F.lit(0)).alias("_n"))))
    quotas = _quotas(spark, src, wanted, total_tokens)
    used_in_all = [q.rounds * q.tokens + q.rest for q in quotas]
    if shards is None:
        shards = max(FEWEST_SHARDS, sum(used_in_all) // SHARD_TOKENS)
    size = max(1, sum(used_in_all) // min(shards * SHARD_BLOCKS, MOST_BLOCKS))
    blocks = [-(-t // size) for t in used_in_all]

    taken = _taken(src, quotas, seed)
    counts = spark.createDataFrame(list(enumerate(blocks)), "_s int, _blocks long")
    out = taken.join(F.broadcast(counts), "_s")  # a row for each target at most
    # Records without tokens at the very end begin behind the last block.
    out = out.withColumn("_block", F.least(F.expr(f"_start div {size}"), F.col("_blocks") - 1))
    draws = out.select(
        F.xxhash64("_place", F.lit(seed + 1)).alias("place"), F.col("_id").alias(record), F.col("_source").alias("source"), F.col("_round").alias("round_no"), F.col("_n").alias("n_tokens"), "_s", "_block"
    )
    names = ["place", record, "source", "round_no", "n_tokens", "shard"]
    kinds = ", ".join(f"`{n}` {draws.schema[n].dataType.simpleString() if n != 'shard' else 'int'}" for n in names)
    draws = draws.mapInArrow(partial(_dealt, blocks=blocks, shards=shards, seed=seed, names=names), kinds).select("shard", *names[:-1])
    draws = draws.repartition(min(shards, MOST_PARTITIONS), "shard").sortWithinPartitions("shard", "place")

    used = taken.groupBy("_source").agg(F.count("*").alias("uses"), (F.max("_round") + 1).alias("most_uses"), F.sum("_n").alias("used_tokens"))
    at_hand = src.groupBy("_source").agg(F.count("*").alias("records"), F.sum("_n").alias("tokens"))
    goals = spark.createDataFrame([tuple(t) for t in wanted], "_goal string, target_share double, max_repeats int")
    everything = at_hand.join(goals, F.col("_source") == F.col("_goal"), "full").join(used.withColumnRenamed("_source", "_used"), F.col("_source") == F.col("_used"), "left")
    zero = F.lit(0).cast("long")
    share = F.coalesce("used_tokens", zero) / F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))
    report = everything.select(
        F.coalesce("_goal", "_source").alias("source"), "target_share", "max_repeats", F.coalesce("records", zero).alias("records"), F.coalesce("tokens", zero).alias("tokens"),
        F.coalesce("uses", zero).alias("uses"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.coalesce("used_tokens", zero).alias("used_tokens"), F.coalesce(share, F.lit(0.0)).alias("actual_share"),
        F.when(F.col("_goal").isNull(), "no target").when(F.coalesce("tokens", zero) == 0, "no records").otherwise("mixed").alias("status"),
    )
    return Mix(draws, report)
