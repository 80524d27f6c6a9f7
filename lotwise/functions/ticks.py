"""Scalar derivations of trades: ticks, days, quantities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the price grid.
TICK = 0.05


def price_to_ticks(price: Column) -> Column:
    return F.round(price / F.lit(TICK)).cast("long")


def ticks_to_value(ticks: Column) -> Column:
    return ticks * F.lit(TICK)


def on_grid(price: Column) -> Column:
    return F.round(F.greatest(price, F.lit(TICK)) / F.lit(TICK)) * F.lit(TICK)


def signed_quantity(side: Column, quantity: Column) -> Column:
    return side.cast("long") * quantity.cast("long")


def day_of(ts: Column) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(F.to_date(ts))


def realized(qty: Column, buy_ticks: Column, sell_ticks: Column, wide: bool = False) -> Column:
    """Ticks gained; ``wide`` keeps 38 digits where a bigint would raise."""
    if wide:
        return qty.cast("decimal(19,0)") * (sell_ticks - buy_ticks).cast("decimal(19,0)")
    return qty * (sell_ticks - buy_ticks)


def relative_error(a: Column, b: Column) -> Column:
    """Absolute under one, relative otherwise."""
    return F.when(F.abs(b) < 1, F.abs(a - b)).otherwise(F.abs((a - b) / b))


def speedup(base: Column, ours: Column) -> Column:
    return F.when(ours <= 0, F.lit(0.0)).otherwise(base / ours)
