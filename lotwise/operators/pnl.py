"""Sums over fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import period_of
from ..functions.rules import BucketRules
from ..functions.ticks import realized, ticks_to_value


def classified(fragments: DataFrame, rules: BucketRules) -> DataFrame:
    return fragments.withColumn("bucket", rules.classify(F.col("sell_day") - F.col("buy_day")))


def sums(wide: bool = False) -> list[Column]:
    total = F.sum(realized(F.col("qty"), F.col("buy_ticks"), F.col("sell_ticks"), wide))
    return [F.count("*").alias("fragments"), F.sum("qty").alias("matched_qty"), (total if wide else total.cast("long")).alias("realized_ticks")]


def counted(fragments: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Fragments whose sell lies in the days [lo, hi]; trades are never cut before matching."""
    df = fragments if lo is None else fragments.where(F.col("sell_day") >= lo)
    return df if hi is None else df.where(F.col("sell_day") <= hi)


def pnl(fragments: DataFrame, rules: BucketRules | None = None, by: tuple[str, ...] = (), wide: bool = False) -> DataFrame:
    """fragments, matched_qty and realized_ticks by ``by`` and bucket; buckets without fragments are absent."""
    return classified(fragments, rules or BucketRules()).groupBy(*by, "bucket").agg(*sums(wide))


def pnl_total(fragments: DataFrame, rules: BucketRules | None = None) -> DataFrame:
    """Every bucket with its label and value in currency, empty ones as zeros, then a row TOTAL."""
    rules = rules or BucketRules()
    spark = fragments.sparkSession
    names = spark.createDataFrame([(i, rules.label(i)) for i in range(rules.count)], "bucket int, label string")
    rolled = classified(fragments, rules).rollup("bucket").agg(*sums())
    known = names.unionByName(spark.createDataFrame([(None, "TOTAL")], "bucket int, label string"))
    zero = F.lit(0).cast("long")
    out = known.join(rolled.withColumnRenamed("bucket", "b"), F.col("bucket").eqNullSafe(F.col("b")), "left")
    return out.select("bucket", "label", *[F.coalesce(c, zero).alias(c) for c in ("fragments", "matched_qty", "realized_ticks")]).withColumn("value", ticks_to_value(F.col("realized_ticks")))


def rollup(fragments: DataFrame, rules: BucketRules | None = None) -> DataFrame:
    """Sums by the sell's month (year * 12 + month - 1) and bucket."""
    return classified(fragments, rules or BucketRules()).withColumn("period", period_of(F.col("sell_day"))).groupBy("period", "bucket").agg(*sums())


def rollup_range(table: DataFrame, lo: int, hi: int) -> DataFrame:
    """Buckets of the months [lo, hi], from a rollup."""
    return table.where(F.col("period").between(lo, hi)).groupBy("bucket").agg(*[F.sum(c).cast("long").alias(c) for c in ("fragments", "matched_qty", "realized_ticks")])


def merge_rollup(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """A rollup with the sums of further fragments (or of corrections, as differences) added in."""
    return old.unionByName(fresh).groupBy("period", "bucket").agg(*[F.sum(c).cast("long").alias(c) for c in ("fragments", "matched_qty", "realized_ticks")])


def compare(a: DataFrame, b: DataFrame, on: tuple[str, ...] = ("bucket",)) -> DataFrame:
    """Rows of two results side by side, with verdict equal, differs, left_only or right_only."""
    values = ("fragments", "matched_qty", "realized_ticks")
    left = a.select(*on, *[F.col(v).alias(f"{v}_a") for v in values])
    right = b.select(*[F.col(c).alias(f"_{c}") for c in on], *[F.col(v).alias(f"{v}_b") for v in values])
    cond = F.lit(True)
    for c in on:
        cond = cond & (F.col(c) == F.col(f"_{c}"))
    same = F.lit(True)
    for v in values:
        same = same & (F.col(f"{v}_a") == F.col(f"{v}_b"))
    out = left.join(right, cond, "full")
    verdict = F.when(F.col(f"{values[0]}_b").isNull(), "left_only").when(F.col(f"{values[0]}_a").isNull(), "right_only").when(same, "equal").otherwise("differs")
    return out.select(*[F.coalesce(c, f"_{c}").alias(c) for c in on], *[f"{v}_{s}" for v in values for s in "ab"], verdict.alias("verdict"))


def holding_histogram(fragments: DataFrame) -> DataFrame:
    """Fragments and quantity by days held."""
    span = (F.col("sell_day") - F.col("buy_day")).alias("span")
    return fragments.groupBy(span).agg(F.count("*").alias("fragments"), F.sum("qty").alias("matched_qty"))
