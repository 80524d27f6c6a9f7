"""Trading days: weekdays, without holidays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The session opens at 03:45 UTC and lasts 6 h 15 min.
SESSION_OPEN_MINUTES, SESSION_MINUTES = 225, 375


def weekday(date: Column) -> Column:
    """0 for Sunday."""
    return F.dayofweek(date) - 1


def is_weekend(date: Column) -> Column:
    return F.dayofweek(date).isin(1, 7)


def trading_days(spark: SparkSession, start: str, n: int) -> DataFrame:
    """idx (from 0), date, day of the first n weekdays from ``start`` on."""
    span = F.sequence(F.to_date(F.lit(start)), F.date_add(F.to_date(F.lit(start)), n // 5 * 7 + 9))
    days = F.slice(F.filter(span, lambda d: ~is_weekend(d)), 1, n)
    return spark.range(1).select(F.posexplode(days).alias("idx", "date")).withColumn("day", F.unix_date("date"))


def session_start(date: Column) -> Column:
    return date.cast("timestamp_ntz") + F.expr(f"INTERVAL {SESSION_OPEN_MINUTES} MINUTE")


def period_of(day: Column) -> Column:
    """Months since year 0: year * 12 + month - 1."""
    date = F.date_from_unix_date(day)
    return (F.year(date) * 12 + F.month(date) - 1).cast("int")


def period_label(period: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(period / 12), F.pmod(period, F.lit(12)) + 1)
