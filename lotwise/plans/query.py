"""The query: which clients and symbol, which days, which rules and policy."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import BucketRules, MatchPolicy
from ..operators import checkpoint
from ..operators.matching import fragments
from ..operators.pnl import pnl, rollup_range
from ..schema import KEY


@dataclass(frozen=True)
class Query:
    """client and symbol None: all; lo and hi None: all history."""

    client: int | None = None
    symbol: int | None = None
    lo: int | None = None
    hi: int | None = None
    rules: BucketRules = field(default_factory=BucketRules)
    policy: MatchPolicy = MatchPolicy.FIFO

    def __post_init__(self) -> None:
        if (self.lo is None) != (self.hi is None):
            raise ValueError("give both ends of the days, or neither")
        if self.lo is not None and self.lo > self.hi:
            raise ValueError("the first day is after the last")

    @property
    def span(self) -> str:
        return "all-history" if self.lo is None else f"range[{self.lo},{self.hi}]"


def select(trades: DataFrame, q: Query) -> DataFrame:
    """Plain predicates on the key, which go below the windows and into the scan."""
    df = trades if q.client is None else trades.where(F.col("client_id") == q.client)
    return df if q.symbol is None else df.where(F.col("symbol_id") == q.symbol)


def run(trades: DataFrame, q: Query, lots: DataFrame | None = None) -> DataFrame:
    """bucket, fragments, matched_qty, realized_ticks; lots: checkpoints to go on from."""
    own = select(trades, q)
    if q.lo is None:
        return pnl(fragments(own, q.policy), q.rules)
    return pnl(checkpoint.range_fragments(own, select(lots, q) if lots is not None else None, q.lo, q.hi, q.policy), q.rules)


def run_from_rollup(table: DataFrame, lo_period: int, hi_period: int) -> DataFrame:
    """Whole months of all clients, from the rollup alone."""
    return rollup_range(table, lo_period, hi_period)


def metrics(trades: DataFrame, q: Query, lots: DataFrame | None = None) -> DataFrame:
    """rows_touched, partition_fanout, max_partition_rows, checkpoints_loaded (keys with carried lots)."""
    own = select(trades, q)
    loaded = F.lit(0).cast("long")
    carry = None
    if q.lo is not None:
        tail = own.where(F.col("day") <= q.hi)
        if lots is not None:
            mine = select(lots, q).where(F.col("policy") == q.policy.value)
            after = checkpoint.nearest(mine, q.lo)
            if after is not None:
                tail = tail.where(F.col("day") > after)
                carry = mine.where(F.col("cutoff_day") == after).select(*KEY).distinct()
        # keys without rows in the days still count
        touched = own.select(*KEY).distinct().join(tail.groupBy(*KEY).agg(F.count("*").alias("n")), list(KEY), "left")
    else:
        touched = own.groupBy(*KEY).agg(F.count("*").alias("n"))
    out = touched.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows_touched"), F.count("*").alias("partition_fanout"), F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("max_partition_rows")
    )
    if carry is None:
        return out.withColumn("checkpoints_loaded", loaded)
    return out.crossJoin(carry.agg(F.count("*").alias("checkpoints_loaded")))  # one row each
