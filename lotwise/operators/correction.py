"""Back-dated corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import BucketRules, MatchPolicy
from ..schema import KEY
from . import checkpoint
from .matching import fragments
from .pnl import compare, pnl


def apply_delta(trades: DataFrame, delta: DataFrame) -> DataFrame:
    """delta: columns of trades and op (insert, update or delete), by key and seq; a later row of trades order is the caller's."""
    gone = delta.where(F.col("op") != "insert").select(*KEY, "seq")
    fresh = delta.where(F.col("op") != "delete").select(*trades.columns)
    return trades.join(gone, [*KEY, "seq"], "left_anti").select(*trades.columns).unionByName(fresh)


def touched(delta: DataFrame) -> DataFrame:
    """Keys of a delta with the first day it touches."""
    return delta.groupBy(*KEY).agg(F.min("day").alias("first_day"))


def recompute(trades: DataFrame, delta: DataFrame, rules: BucketRules | None = None, policy: MatchPolicy = MatchPolicy.FIFO) -> DataFrame:
    """Sums by key and bucket after the correction, of the keys it touches only."""
    keys = touched(delta).select(*KEY)
    own = apply_delta(trades.join(keys, list(KEY), "left_semi"), delta)
    return pnl(fragments(own, policy), rules, KEY)


def difference(trades: DataFrame, delta: DataFrame, rules: BucketRules | None = None, policy: MatchPolicy = MatchPolicy.FIFO) -> DataFrame:
    """Before and after side by side, of the touched keys."""
    keys = touched(delta).select(*KEY)
    before = pnl(fragments(trades.join(keys, list(KEY), "left_semi"), policy), rules, KEY)
    return compare(before, recompute(trades, delta, rules, policy), (*KEY, "bucket"))


def stale(cutoffs: DataFrame, delta: DataFrame) -> DataFrame:
    """Checkpoints to build anew."""
    day = delta.agg(F.min("day").alias("d"))
    return cutoffs.join(day, F.col("cutoff_day") >= F.col("d"), "left_semi")


def rebuild(trades: DataFrame, lots: DataFrame, delta: DataFrame, policy: MatchPolicy = MatchPolicy.FIFO) -> DataFrame:
    """Checkpoints after a correction: of stale cutoffs only the touched keys are matched again, from the last sound cutoff."""
    day = delta.agg(F.min("day")).first()[0]
    own = lots.where(F.col("policy") == policy.value)
    old = [r[0] for r in checkpoint.listing(lots, policy).collect()]  # a few cutoffs
    keys = touched(delta).select(*KEY)
    redo = [c for c in old if day is not None and c >= day]
    if not redo:
        return own
    fixed = apply_delta(trades.join(keys, list(KEY), "left_semi"), delta)
    sound = max((c for c in old if c < day), default=None)
    if sound is None:
        fresh = checkpoint.build(fixed, redo, policy)
    else:
        carry = own.where(F.col("cutoff_day") == sound).join(keys, list(KEY), "left_semi").drop("policy", "cutoff_day")
        fresh = checkpoint.build(fixed.where(F.col("day") > sound), redo, policy, carry, sound)
    kept = own.where(~F.col("cutoff_day").isin(redo)).unionByName(own.where(F.col("cutoff_day").isin(redo)).join(keys, list(KEY), "left_anti").select(*own.columns), allowMissingColumns=True)
    return kept.unionByName(fresh.select(*kept.columns))
