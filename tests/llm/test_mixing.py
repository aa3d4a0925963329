from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.mixing import SHARD_BLOCKS, SplittingTree, mix_sources

SCHEMA = "id long, src string, n long, shard int, _n long"


def records(seed=0, sizes=(("a", 3000), ("b", 900), ("c", 60), ("d", 40), (None, 10))):
    rng = random.Random(seed)
    return [(i, s, rng.choice([0, 1, 5, 40, 200, None]), 1, 2) for i, s in enumerate(s for s, n in sizes for _ in range(n))]


def mixed(spark, rows, targets, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return mix_sources(df, "id", "src", "n", spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), **more)


TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 8), ("missing", 0.1, 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_shares_and_repeats(spark, seed):
    rows = records()
    m = mixed(spark, rows, TARGETS, seed=seed)
    draws, report = m.draws.collect(), {r.source: r for r in m.report.collect()}
    size = {i: n or 0 for i, _, n, *_ in rows}
    used = Counter()
    for d in draws:
        assert d.n_tokens == size[d.id] and 0 <= d.shard < 16
        used[d.source] += d.n_tokens
    uses = Counter(d.id for d in draws)
    source = {i: s for i, s, *_ in rows}
    limit = {s: r for s, _, r in TARGETS}
    assert all(n <= limit[source[i]] for i, n in uses.items())
    assert len({(d.id, d.round_no) for d in draws}) == len(draws)
    total = sum(used.values())
    for s, share in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
        assert abs(used[s] - share * total) <= 2 * max(size.values()), (s, used[s] / total)
        assert report[s].used_tokens == used[s] and abs(report[s].actual_share - used[s] / total) < 1e-12 and report[s].status == "mixed"
        assert report[s].uses == sum(d.source == s for d in draws) and report[s].most_uses <= limit[s]
    reach = {s: limit[s] * sum(size[i] for i in size if source[i] == s) / share for s, share in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9))}
    assert total >= 0.99 * min(reach.values()) - 600
    assert report["missing"].status == "no records" and report["d"].status == "no target" and report[None].status == "no target"


def test_same_seed_same_mix(spark):
    rows = records()
    a, b = ([tuple(r) for r in mixed(spark, rows, TARGETS, seed=5).draws.collect()] for _ in range(2))
    c = [tuple(r) for r in mixed(spark, rows[::-1], TARGETS, seed=5).draws.collect()]
    d = [tuple(r) for r in mixed(spark, rows, TARGETS, seed=6).draws.collect()]
    assert sorted(a) == sorted(b) == sorted(c) != sorted(d)


def test_total_and_order_within_shards(spark):
    m = mixed(spark, records(), TARGETS, total_tokens=20_000, shards=5)
    draws = m.draws.collect()
    assert 20_000 - 3 * 201 <= sum(d.n_tokens for d in draws) <= 20_000
    for s in range(5):
        places = [d.place for d in draws if d.shard == s]
        assert places == sorted(places) and places
    per = [sum(d.n_tokens for d in draws if d.shard == s) for s in range(5)]
    assert max(per) < 1.4 * min(per)


def test_partial_round_is_a_random_part(spark):
    rows = [(i, "a" if i % 2 else "b", 1, 0, 0) for i in range(20_000)]
    draws = mixed(spark, rows, [("a", 0.2, 1), ("b", 0.8, 1)]).draws.collect()
    ids = [d.id for d in draws if d.source == "a"]
    assert abs(len(ids) - 2500) <= 1 and abs(np.mean(ids) - 10_000) < 500


def test_equal_ids_have_places_of_their_own(spark, monkeypatch):
    """A third of the ids null and a third equal: the share is still met to one record, and the records spread over the shards."""
    monkeypatch.setattr("millrace.llm.mixing.COPIES", 300)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, "a", 1 + i % 2, 0, 0) for i in range(6000)] + [(i, "b", 1, 0, 0) for i in range(10_000, 12_000)]
    a, b = (mixed(spark, x, [("a", 0.6, 1), ("b", 0.4, 1)]) for x in (rows, rows[::-1]))
    draws = a.draws.collect()
    assert abs(sum(d.n_tokens for d in draws if d.source == "a") - 3000) <= 2
    for same in (None, 7):
        assert len({d.shard for d in draws if d.source == "a" and d.id == same}) == 16
    assert sorted(map(str, draws)) == sorted(map(str, b.draws.collect()))


def test_splitting_tree():
    rng = random.Random(0)
    for shards in (1, 2, 7, 64):
        blocks = [rng.randint(0, 500) for _ in range(6)]
        tree = SplittingTree(blocks, shards, 3)
        out = tree.table()
        assert out.sum(0).tolist() == blocks and (out >= 0).all()
        assert out.sum(1).max() - out.sum(1).min() <= 7
        source, block = np.array([(s, b) for s, n in enumerate(blocks) for b in range(n)]).T
        order = np.random.default_rng(1).permutation(len(source))
        got = np.zeros_like(out)
        np.add.at(got, (SplittingTree(blocks, shards, 3).shards_of(source[order], block[order]), source[order]), 1)
        assert (got == out).all()
    means = np.mean([SplittingTree([100, 300], 4, s).table()[0] for s in range(300)], axis=0)
    assert np.allclose(means, [25, 75], atol=1)
    assert SplittingTree([], 3, 0).table().shape == (3, 0)


@pytest.mark.parametrize("shards", [16, 1024])
def test_shards_hold_the_mix(spark, shards):
    """Sources of very different numbers of records; each shard has the same tokens and each source's share of them."""
    want = {"a": 0.4, "b": 0.3, "c": 0.22, "d": 0.08}
    kinds = F.expr("case when id < 120000 then 'a' when id < 190000 then 'b' when id < 199000 then 'c' else 'd' end")
    df = spark.range(0, 200_000, 1, 4).select("id", kinds.alias("src"), (F.pmod(F.xxhash64("id"), F.lit(30)) + 5).alias("n"))
    targets = spark.createDataFrame([(s, x, 9) for s, x in want.items()], "source string, target_share double, max_repeats int")
    draws = mix_sources(df, "id", "src", "n", targets, shards=shards).draws
    found = draws.groupBy("shard").pivot("source").sum("n_tokens").fillna(0).toPandas().set_index("shard")[list(want)]
    total = found.sum(axis=1)
    assert len(found) == shards and (total / total.mean()).between(0.9, 1.1).all()
    longest = 2 * 35 / total.mean()
    for s, x in want.items():
        off = (found[s] / total - x).abs()
        assert off.max() <= 5 * (x * (1 - x) / SHARD_BLOCKS) ** 0.5 + longest, (s, off.max())


def test_edges(spark):
    m = mixed(spark, [], TARGETS)
    assert m.draws.count() == 0 and {r.source: r.status for r in m.report.collect()} == {s: "no records" for s, *_ in TARGETS}
    assert mixed(spark, records(), []).draws.count() == 0
    assert mixed(spark, [(1, "a", 0, 1, 1), (2, "a", None, 1, 1)], [("a", 1.0, 3)]).draws.count() == 0
    rows = [(None, "a", 5, 1, 1), (None, "a", 5, 1, 1), (7, "a", 5, 1, 1), (7, "a", 5, 1, 1)]
    m = mixed(spark, rows, [("a", 1.0, 2)])
    assert m.draws.count() == 8 and m.report.first().used_tokens == 40
    assert mixed(spark, rows, [("a", 1.0, 0)]).draws.count() == 0
