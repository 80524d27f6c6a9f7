"""Partitions and pages of a packed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import KEY

#: Records of a page.
PAGE = 262_144


def partition_counts(trades: DataFrame) -> DataFrame:
    return trades.groupBy(*KEY).agg(F.count("*").alias("rows"))


def partition_offsets(trades: DataFrame, buckets: int = 64) -> DataFrame:
    """rows and start (rows of all partitions before it, by client and symbol).

    Sums go over ranges of clients first: within a range by window, between ranges over one row each.
    """
    counts = partition_counts(trades)
    span = counts.agg(F.min("client_id").alias("lo"), F.max("client_id").alias("hi"))
    df = counts.crossJoin(span).withColumn("_r", F.floor((F.col("client_id") - F.col("lo")) * buckets / (F.col("hi") - F.col("lo") + 1)))  # span is one row
    inner = F.sum("rows").over(W.partitionBy("_r").orderBy(*KEY).rowsBetween(W.unboundedPreceding, -1))
    base = df.groupBy("_r").agg(F.sum("rows").alias("_t")).select(F.col("_r").alias("_q"), F.coalesce(F.sum("_t").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return df.withColumn("_in", F.coalesce(inner, F.lit(0))).join(base, F.col("_r") == F.col("_q")).select(*KEY, "rows", (F.col("_in") + F.col("_b")).cast("long").alias("start"))


def with_row_number(trades: DataFrame) -> DataFrame:
    """rn from 0 in the packed order (client, symbol, seq), without bringing the table into one partition."""
    offsets = partition_offsets(trades).select(*[F.col(k).alias(f"_{k}") for k in KEY], "start")
    place = F.row_number().over(W.partitionBy(*KEY).orderBy("seq")) - 1
    on = (F.col(KEY[0]) == F.col(f"_{KEY[0]}")) & (F.col(KEY[1]) == F.col(f"_{KEY[1]}"))
    return trades.withColumn("_p", place).join(offsets, on).withColumn("rn", (F.col("start") + F.col("_p")).cast("long")).select(*trades.columns, "rn")


def page_summary(trades: DataFrame, page: int = PAGE) -> DataFrame:
    """page, row_start, row_end (exclusive), and the least and largest client and day of each page."""
    df = with_row_number(trades).withColumn("page", F.floor(F.col("rn") / page))
    return df.groupBy("page").agg(
        F.min("rn").alias("row_start"), (F.max("rn") + 1).alias("row_end"),
        F.min("client_id").alias("min_client"), F.max("client_id").alias("max_client"), F.min("day").alias("min_day"), F.max("day").alias("max_day"),
    )


def page_prune(summary: DataFrame, clients: tuple[int, int], days: tuple[int, int]) -> DataFrame:
    """Pages that may hold rows of the clients and days (both ends included)."""
    return summary.where((F.col("max_client") >= clients[0]) & (F.col("min_client") <= clients[1]) & (F.col("max_day") >= days[0]) & (F.col("min_day") <= days[1]))


def key_changes(rows: DataFrame, order: str = "rn") -> DataFrame:
    """Partition starts in rows that carry their place: where the key differs from the row before (by place)."""
    before = rows.select((F.col(order) + 1).alias("_o"), *[F.col(k).alias(f"_{k}") for k in KEY])
    changed = F.col("_o").isNull() | (F.col(KEY[0]) != F.col(f"_{KEY[0]}")) | (F.col(KEY[1]) != F.col(f"_{KEY[1]}"))
    return rows.join(before, F.col(order) == F.col("_o"), "left").where(changed).select(*KEY, F.col(order).alias("start"))
