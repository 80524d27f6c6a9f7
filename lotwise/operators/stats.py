"""Skew of trades over clients.  The relation they rest on has one row a client and count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUANTILES = (0.5, 0.9, 0.99, 0.999, 0.9999)
FRACTIONS = (1e-4, 1e-3, 0.01, 0.1)


def client_counts(trades: DataFrame) -> DataFrame:
    return trades.groupBy("client_id").agg(F.count("*").alias("n"))


def _ladder(trades: DataFrame) -> DataFrame:
    """One row for each count of trades: clients with it, and clients and trades up to and with it.  Its size is the number of different counts."""
    steps = client_counts(trades).groupBy("n").agg(F.count("*").alias("clients"))
    up = W.orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    return steps.select("n", "clients", F.sum("clients").over(up).alias("c_upto"), F.sum(F.col("n") * F.col("clients")).over(up).alias("t_upto"))


def summary(trades: DataFrame, days: int, whale_stride: int = 0, n_whales: int = 0) -> DataFrame:
    """clients, total, mean, per_day, most, and the whales' share (0 without whales)."""
    whale = F.lit(False) if not whale_stride else is_whale(F.col("client_id"), whale_stride, n_whales)
    return client_counts(trades).agg(
        F.count("*").alias("clients"), F.sum("n").alias("total"), F.avg("n").alias("mean"), (F.sum("n") / F.lit(days)).alias("per_day"),
        F.max("n").alias("most"), (F.sum(F.when(whale, F.col("n")).otherwise(0)) / F.sum("n")).alias("whale_share"),
    )


def is_whale(client, stride: int, n_whales: int):
    return (client % stride == 0) & (client / stride < n_whales)


def percentiles(trades: DataFrame, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """q and the count at place round(q * (n - 1)) of the sorted counts."""
    ladder = _ladder(trades)
    total = ladder.agg(F.max("c_upto").alias("m"))
    wanted = ladder.sparkSession.createDataFrame([(float(q),) for q in quantiles], "q double")
    place = F.round(F.col("q") * (F.col("m") - 1)).cast("long")
    asked = wanted.crossJoin(total).withColumn("at", place)  # a handful of rows
    return asked.join(ladder, (F.col("at") >= F.col("c_upto") - F.col("clients")) & (F.col("at") < F.col("c_upto"))).select("q", F.col("n").alias("trades"))


def top_share(trades: DataFrame, fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """fraction, k = ceil(f * clients) within 1 and all, and the share of trades of the k largest clients."""
    ladder = _ladder(trades)
    total = ladder.agg(F.max("c_upto").alias("m"), F.max("t_upto").alias("t"))
    wanted = ladder.sparkSession.createDataFrame([(float(f),) for f in fractions], "fraction double")
    k = F.greatest(F.lit(1), F.least(F.ceil(F.col("fraction") * F.col("m")), F.col("m"))).cast("long")
    asked = wanted.crossJoin(total).withColumn("k", k)
    # trades of the m - k smallest clients
    at = F.col("m") - F.col("k")
    hit = asked.join(ladder, (at >= F.col("c_upto") - F.col("clients")) & (at < F.col("c_upto")))
    below = F.col("t_upto") - F.col("n") * (F.col("c_upto") - at)
    return hit.select("fraction", "k", ((F.col("t") - below) / F.col("t")).alias("share"))


def log2_histogram(trades: DataFrame) -> DataFrame:
    """lo, hi and clients of each [2^i, 2^(i+1)) from 1 to the largest count, empty ones included."""
    # places of the leading bit: exact where floating logarithms are not
    level = (F.length(F.bin("n")) - 1).alias("i")
    found = client_counts(trades).where("n >= 1").groupBy(level).agg(F.count("*").alias("clients"))
    every = found.agg(F.max("i").alias("top")).select(F.explode(F.sequence(F.lit(0), F.col("top"))).alias("j"))
    one = F.lit(1).cast("long")
    return every.join(found, F.col("i") == F.col("j"), "left").select(
        F.expr("shiftleft(1L, j)").alias("lo"), F.expr("shiftleft(1L, j + 1)").alias("hi"), F.coalesce("clients", one - one).alias("clients")
    )


def whale_and_retail(trades: DataFrame, least: int = 4) -> DataFrame:
    """role and client_id: the client of most trades, and the first other one with at least ``least`` (else the first client)."""
    counts = client_counts(trades)
    whale = counts.select(F.lit("whale").alias("role"), "client_id", "n").orderBy(F.col("n").desc(), "client_id").limit(1)
    other = counts.join(whale.select(F.col("client_id").alias("w")), F.col("client_id") == F.col("w"), "left_anti")
    retail = other.where(F.col("n") >= least).orderBy("client_id").limit(1).select(F.lit("retail").alias("role"), "client_id")
    first = counts.orderBy("client_id").limit(1).select(F.lit("retail").alias("role"), "client_id", F.lit(1).alias("turn"))
    pick = retail.withColumn("turn", F.lit(0)).unionByName(first).orderBy("turn").limit(1)
    return whale.select("role", "client_id").unionByName(pick.select("role", "client_id"))
