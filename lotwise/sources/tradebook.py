"""Trades from files and from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ticks import day_of, price_to_ticks, signed_quantity
from ..schema import KEY, SYMBOLS, TRADEBOOK, validate


def read_tradebook(spark: SparkSession, path: str) -> DataFrame:
    """A folder of Parquet parts; ValueError where a column is missing or of another type."""
    return validate(spark.read.parquet(path), TRADEBOOK)


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    return validate(spark.read.parquet(path), SYMBOLS)


def to_trades(book: DataFrame) -> DataFrame:
    """The six columns that matching needs, ordered within a key by (ts, trade_id)."""
    place = F.row_number().over(W.partitionBy(*KEY).orderBy("ts", "trade_id")).cast("long")
    return book.select(
        *KEY, place.alias("seq"), signed_quantity(F.col("side"), F.col("quantity")).alias("signed_qty"),
        price_to_ticks(F.col("price")).alias("price_ticks"), day_of(F.col("ts")).alias("day"),
    )


def row_count(spark: SparkSession, path: str) -> int:
    """From the files' footers: no column is read."""
    return spark.read.parquet(path).count()


def lineitem_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' trades in twenty symbols; returned items are sells."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    # the key is named before the window, so that matching finds the rows dealt out as it wants them
    keyed = li.withColumn("client_id", F.col("l_suppkey")).withColumn("symbol_id", F.col("l_partkey") % 20)
    order = W.partitionBy(*KEY).orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    return keyed.select(
        *KEY, F.row_number().over(order).cast("long").alias("seq"),
        (F.when(F.col("l_returnflag") == "R", -1).otherwise(1) * F.col("l_quantity").cast("long")).alias("signed_qty"),
        price_to_ticks(F.col("l_extendedprice") / F.col("l_quantity")).alias("price_ticks"), day_of(F.col("l_shipdate")).alias("day"),
    )


def event_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as trades in one symbol; purchases and errors are sells."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return ev.select(
        F.col("user_id").alias("client_id"), F.lit(0).cast("long").alias("symbol_id"), F.row_number().over(order).cast("long").alias("seq"),
        (F.when(F.col("event_type").isin("purchase", "error"), -1).otherwise(1) * F.greatest(F.lit(1), F.floor("value")).cast("long")).alias("signed_qty"),
        price_to_ticks(20 + F.col("value")).alias("price_ticks"), day_of(F.col("ts")).alias("day"),
    )


def whale_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items as one key.  Places are given by ranges of days first, so that no task orders the whole."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("day", day_of(F.col("l_shipdate")))
    cols = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag"]
    inner = F.row_number().over(W.partitionBy("day").orderBy(*cols))
    days = li.groupBy("day").agg(F.count("*").alias("_n"))  # a row a day
    base = days.select(F.col("day").alias("_d"), F.coalesce(F.sum("_n").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    zero = F.lit(0).cast("long")
    return li.withColumn("_i", inner).join(base, F.col("day") == F.col("_d")).select(
        zero.alias("client_id"), zero.alias("symbol_id"), (F.col("_i") + F.col("_b")).cast("long").alias("seq"),
        (F.when(F.col("l_returnflag") == "R", -1).otherwise(1) * F.col("l_quantity").cast("long")).alias("signed_qty"),
        price_to_ticks(F.col("l_extendedprice") / F.col("l_quantity")).alias("price_ticks"), "day",
    )
