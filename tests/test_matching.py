from __future__ import annotations

import random

import pytest
from helpers import fold, frame, got, want
from pyspark.sql import functions as F

from lotwise.functions.rules import BucketRules, MatchPolicy
from lotwise.operators import accumulators, matching, pnl

FIFO, LIFO, HIFO = MatchPolicy


def random_keys(seed, n=60):
    """Many oversells, price ties, zero quantities, keys of one side only."""
    r = random.Random(seed)
    keys = {}
    for k in range(n):
        day, rows = 0, []
        for _ in range(r.randint(1, 25)):
            day += r.choice([0, 0, 1, 40, 400])
            side = r.choice([1, -1]) if k % 5 else r.choice([[1], [-1]][k % 2])
            rows.append((side * r.choice([0, 1, 5, 5, 10, 37]), r.choice([100, 100, 200, 300]), day))
        keys[k, k % 3] = rows
    return keys


def buckets(df, rules=None):
    return {r.bucket: (r.fragments, r.matched_qty, r.realized_ticks) for r in pnl.pnl(df, rules).collect()}


def test_three_buckets(spark):
    t = frame(spark, {(1, 1): [(100, 2000, 1), (-60, 2200, 1), (-40, 2400, 100), (10, 2000, 200), (-10, 2600, 700)]})
    assert buckets(matching.fragments(t)) == {0: (1, 60, 12000), 1: (1, 40, 16000), 2: (1, 10, 6000)}


def test_oldest_first(spark):
    t = frame(spark, {(1, 1): [(100, 1000, 1), (100, 2000, 2), (-150, 3000, 3)]})
    assert buckets(matching.fragments(t)) == {1: (2, 150, 250000)}


@pytest.mark.parametrize(("policy", "ticks"), [(FIFO, 300000), (LIFO, 400000), (HIFO, 200000)])
def test_policies(spark, policy, ticks):
    t = frame(spark, {(1, 1): [(100, 2000, 1), (100, 3000, 2), (100, 1000, 3), (-100, 5000, 4)]})
    assert buckets(matching.fragments(t, policy)) == {1: (1, 100, ticks)}


def test_rules(spark):
    t = frame(spark, {(1, 1): [(100, 1000, 0), (-100, 1200, 200)]})
    assert set(buckets(matching.fragments(t), BucketRules.equity(365))) == {1}
    assert set(buckets(matching.fragments(t), BucketRules.equity(100))) == {2}
    assert buckets(matching.fragments(t), BucketRules.bands([30, 365])) == {2: (1, 100, 20000)}
    spans = spark.createDataFrame([(s,) for s in (0, 10, 30, 31, 200, 365, 366, 500)], "s int")
    assert [r[0] for r in spans.select(BucketRules.bands([30, 365]).classify(F.col("s"))).collect()] == [0, 1, 1, 2, 2, 2, 3, 3]
    many = BucketRules.bands(list(range(1, 13)))
    assert many.count == 14 and many.label(13) == ">12d"
    assert [BucketRules.bands("30, 365").label(i) for i in range(4)] == ["intraday", "1-30d", "31-365d", ">365d"]
    assert BucketRules((10,), False).label(0) == "0-10d"
    for bad in ([], [5, 5], [9, 3], [0, 4]):
        with pytest.raises(ValueError):
            BucketRules.bands(bad)
    with pytest.raises(ValueError):
        BucketRules.bands("a,b")
    with pytest.raises(ValueError):
        MatchPolicy.of("best")


def test_oversold_remainder_is_dropped(spark):
    keys = {(1, 1): [(10, 100, 1), (-30, 200, 2), (20, 300, 3), (-20, 400, 4)]}
    assert got(matching.fragments(frame(spark, keys))) == [(1, 1, 1, 2, 1, 2, 10, 100, 200), (1, 1, 3, 4, 3, 4, 20, 300, 400)]


@pytest.mark.parametrize("policy", list(MatchPolicy))
def test_against_fold(spark, policy):
    keys = random_keys(7)
    df = frame(spark, keys)
    assert got(matching.fragments(df, policy)) == want(keys, policy)
    lots = sorted((r.client_id, r.symbol_id, r.seq, r.signed_qty, r.price_ticks, r.day) for r in matching.open_lots(df, policy).collect())
    assert lots == sorted((*k, *lot) for k, rows in keys.items() for lot in fold(rows, policy)[1])


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_chunked_is_the_same(spark, chunk):
    keys = random_keys(11, 40)
    assert got(matching.fragments(frame(spark, keys), chunk=chunk)) == want(keys)


@pytest.mark.parametrize("policy", list(MatchPolicy))
def test_carry_goes_on(spark, policy):
    keys = random_keys(5, 40)
    df = frame(spark, keys)
    cut = 60
    carry = matching.open_lots(df.where(F.col("day") <= cut), policy)
    later = matching.fragments(df.where(F.col("day") > cut), policy, carry)
    assert got(later) == [f for f in want(keys, policy) if f[5] > cut]


def test_empty(spark):
    t = frame(spark, {})
    for policy in MatchPolicy:
        assert matching.fragments(t, policy).count() == 0
        assert matching.open_lots(t, policy).count() == 0
    total = {r.label: r.fragments for r in pnl.pnl_total(matching.fragments(t)).collect()}
    assert total == {"intraday": 0, "1-365d": 0, ">365d": 0, "TOTAL": 0}


def test_wide_sums_where_bigint_would_overflow(spark):
    t = frame(spark, {(1, 1): [(4_000_000_000, 1, 1), (-4_000_000_000, 4_000_000_000, 2)]})
    frags = matching.fragments(t)
    with pytest.raises(Exception, match="overflow|OVERFLOW"):
        pnl.pnl(frags).collect()
    assert pnl.pnl(frags, wide=True).first()["realized_ticks"] == 4_000_000_000 * 3_999_999_999


def test_average_cost(spark):
    t = frame(spark, {(1, 1): [(10, 100, 1), (10, 200, 2), (-10, 300, 3), (-15, 300, 4), (5, 400, 5), (-5, 500, 6)]})
    rows = [(r.sell_seq, r.qty, r.cost_ticks, r.realized_ticks) for r in matching.average_cost(t).orderBy("sell_seq").collect()]
    assert rows == [(3, 10, 150.0, 1500.0), (4, 10, 150.0, 1500.0), (6, 5, 400.0, 500.0)]


def test_specific_lots(spark):
    t = frame(spark, {(1, 1): [(10, 100, 1), (10, 200, 2), (-12, 300, 3), (-10, 300, 4)]})
    picks = spark.createDataFrame([(1, 1, 3, 2, 8), (1, 1, 3, 1, 9), (1, 1, 4, 2, 9)], "client_id long, symbol_id long, sell_seq long, buy_seq long, qty long")
    assert [(f[2], f[3], f[6]) for f in got(matching.specific_lot_fragments(t, picks))] == [(1, 3, 9), (2, 3, 3), (2, 4, 7)]


def test_position_and_drawdown(spark):
    t = frame(spark, {(1, 1): [(10, 100, 1), (-30, 200, 2), (20, 300, 3), (-20, 250, 4)]})
    assert [r.position for r in accumulators.running_position(t).orderBy("seq").collect()] == [10, 0, 20, 0]
    assert accumulators.max_drawdown(matching.fragments(t)).first()["max_drawdown_ticks"] == 1000
