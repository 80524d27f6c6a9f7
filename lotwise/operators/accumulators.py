"""Further sums over trades and fragments: position, prices, exposure, drawdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ticks import realized
from ..schema import KEY
from .matching import UP_TO, _effective, open_lots


def running_position(trades: DataFrame) -> DataFrame:
    """Position after each trade; sells beyond it are dropped."""
    return _effective(trades).select(*KEY, "seq", "day", F.col("inv").alias("position"))


def vwap(trades: DataFrame) -> DataFrame:
    """Volume-weighted average price in ticks, by key."""
    q = F.abs("signed_qty")
    return trades.groupBy(*KEY).agg(F.sum(q).alias("volume"), (F.sum(q * F.col("price_ticks")) / F.sum(q)).alias("vwap_ticks"))


def running_vwap(trades: DataFrame) -> DataFrame:
    w = W.partitionBy(*KEY).orderBy("seq").rowsBetween(*UP_TO)
    q = F.abs("signed_qty")
    return trades.select(*KEY, "seq", (F.sum(q * F.col("price_ticks")).over(w) / F.sum(q).over(w)).alias("vwap_ticks"))


def average_buy(trades: DataFrame) -> DataFrame:
    """Average price of all buys so far, at each buy."""
    w = W.partitionBy(*KEY).orderBy("seq").rowsBetween(*UP_TO)
    return trades.where("signed_qty > 0").select(*KEY, "seq", (F.sum(F.col("signed_qty") * F.col("price_ticks")).over(w) / F.sum("signed_qty").over(w)).alias("avg_buy_ticks"))


def last_prices(trades: DataFrame) -> DataFrame:
    return trades.groupBy(*KEY).agg(F.max_by("price_ticks", "seq").alias("mark_ticks"))


def exposure(trades: DataFrame) -> DataFrame:
    """Position at the end times the last price, in ticks."""
    last = _effective(trades).groupBy(*KEY).agg(F.max_by("inv", "seq").alias("position"), F.max_by("price_ticks", "seq").alias("mark_ticks"))
    return last.withColumn("exposure_ticks", F.col("position") * F.col("mark_ticks"))


def unrealized(trades: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Open quantity and gain of the open lots at the marks (default: last prices), by key; keys without open lots are absent."""
    lots = open_lots(trades)
    by = lots.join(marks if marks is not None else last_prices(trades), list(KEY))
    return by.groupBy(*KEY).agg(F.sum("signed_qty").alias("open_qty"), F.sum(F.col("signed_qty") * (F.col("mark_ticks") - F.col("price_ticks"))).alias("unrealized_ticks"))


def max_drawdown(fragments: DataFrame) -> DataFrame:
    """Largest fall of a client's realized ticks, summed by day, from an earlier peak (from 0 on)."""
    daily = fragments.groupBy("client_id", "sell_day").agg(F.sum(realized(F.col("qty"), F.col("buy_ticks"), F.col("sell_ticks"))).alias("r"))
    w = W.partitionBy("client_id").orderBy("sell_day").rowsBetween(*UP_TO)
    run = daily.withColumn("cum", F.sum("r").over(w))
    peak = run.withColumn("peak", F.greatest(F.lit(0), F.max("cum").over(w)))
    return peak.groupBy("client_id").agg(F.max(F.col("peak") - F.col("cum")).alias("max_drawdown_ticks"))
