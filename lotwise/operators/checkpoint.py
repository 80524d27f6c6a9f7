"""Open lots at a day's end, kept by policy and day, so that a range of days need not be matched from the beginning."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import MatchPolicy
from .matching import fragments, open_lots
from .pnl import counted


def lots_at(trades: DataFrame, cutoff: int, policy: MatchPolicy = MatchPolicy.FIFO) -> DataFrame:
    """Lots open after all trades of days up to ``cutoff``."""
    return open_lots(trades.where(F.col("day") <= cutoff), policy)


def build(trades: DataFrame, cutoffs: list[int], policy: MatchPolicy = MatchPolicy.FIFO, carry: DataFrame | None = None, after: int | None = None) -> DataFrame:
    """Lots at each cutoff, with policy and cutoff_day.  Each cutoff goes on from the lots of the one before it; carry: lots open after day ``after``."""
    out = None
    for c in sorted(cutoffs):
        part = trades.where(F.col("day") <= c) if after is None else trades.where((F.col("day") > after) & (F.col("day") <= c))
        carry, after = open_lots(part, policy, carry), c
        kept = carry.withColumn("policy", F.lit(policy.value)).withColumn("cutoff_day", F.lit(c))
        out = kept if out is None else out.unionByName(kept)
    if out is None:
        raise ValueError("at least one cutoff is needed")
    return out


def cutoffs_of(days: list[int], n: int) -> list[int]:
    """n cutoffs that divide a list of trading days."""
    return [days[len(days) * k // (n + 1)] for k in range(1, n + 1)]


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def clear(spark: SparkSession, path: str, policy: MatchPolicy) -> None:
    """Remove a policy's checkpoints."""
    fs, p = _folder(spark, f"{path}/policy={policy.value}")
    fs.delete(p, True)


def write(lots: DataFrame, path: str) -> None:
    """Replace the checkpoints of the policies that lots hold, cutoffs that are no longer among them included, and leave those of other policies.

    New ones are written beside the old first, so lots may come from the path itself.  A policy without any lots is left to ``clear``.
    """
    spark = lots.sparkSession
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    lots.write.partitionBy("policy", "cutoff_day").parquet(staged)
    fs, p = _folder(spark, staged)
    for policy in MatchPolicy:
        fresh = _folder(spark, f"{staged}/policy={policy.value}")[1]
        if fs.exists(fresh):
            clear(spark, path, policy)
            fs.rename(fresh, _folder(spark, f"{path}/policy={policy.value}")[1])
    fs.delete(p, True)


def written_cutoffs(spark: SparkSession, path: str, policy: MatchPolicy = MatchPolicy.FIFO) -> list[int]:
    """Cutoffs with lots at a path, ascending, from the names of folders alone."""
    fs, p = _folder(spark, f"{path}/policy={policy.value}")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("cutoff_day="))


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def listing(lots: DataFrame, policy: MatchPolicy = MatchPolicy.FIFO) -> DataFrame:
    """Cutoffs there are, ascending."""
    return lots.where(F.col("policy") == policy.value).select("cutoff_day").distinct().orderBy("cutoff_day")


def nearest(cutoffs: DataFrame, before: int) -> int | None:
    """The latest cutoff_day strictly before a day."""
    return cutoffs.where(F.col("cutoff_day") < before).agg(F.max("cutoff_day")).first()[0]


def invalidated(cutoffs: DataFrame, day: int) -> DataFrame:
    """Cutoffs that a correction of a day makes stale."""
    return cutoffs.where(F.col("cutoff_day") >= day)


def range_fragments(trades: DataFrame, lots: DataFrame | None, lo: int, hi: int, policy: MatchPolicy = MatchPolicy.FIFO) -> DataFrame:
    """Fragments of sells in [lo, hi], from the nearest checkpoint of the policy on; without one from the beginning."""
    carry, after = None, None
    if lots is not None:
        own = lots.where(F.col("policy") == policy.value)
        after = nearest(own, lo)
        carry = own.where(F.col("cutoff_day") == after) if after is not None else None
    tail = trades.where(F.col("day") <= hi)
    if after is not None:
        tail = tail.where(F.col("day") > after)
    return counted(fragments(tail, policy, carry), lo, hi)
