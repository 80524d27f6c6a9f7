"""A small additive cost model that picks how a query is run."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Coefficients:
    """Nanoseconds.  Fixed values: the defaults are the published priors."""

    cpu_per_row: float = 3.0
    gpu_per_row: float = 0.2
    h2d_per_row: float = 1.6
    launch_per_partition: float = 2000.0
    serial_per_row: float = 0.2 / 256
    per_checkpoint: float = 500.0
    fixed: float = 50_000.0

    def predict(self, rows: int, fanout: int, longest: int, checkpoints: int) -> dict[str, float]:
        scan = self.cpu_per_row * rows + self.per_checkpoint * checkpoints
        device = self.fixed + (self.gpu_per_row + self.h2d_per_row) * rows + self.launch_per_partition * fanout + self.serial_per_row * longest
        return {"cpu": scan, "gpu": device}

    def route(self, rows: int, fanout: int, longest: int, checkpoints: int) -> str:
        """The cheaper; a tie goes to cpu."""
        cost = self.predict(rows, fanout, longest, checkpoints)
        return "gpu" if cost["gpu"] < cost["cpu"] else "cpu"


def predict_columns(metrics: DataFrame, c: Coefficients | None = None) -> DataFrame:
    """metrics (rows_touched, partition_fanout, max_partition_rows, checkpoints_loaded) with cpu_ns, gpu_ns and route."""
    c = c or Coefficients()
    cpu = F.col("rows_touched") * F.lit(c.cpu_per_row) + F.col("checkpoints_loaded") * F.lit(c.per_checkpoint)
    gpu = F.lit(c.fixed) + F.col("rows_touched") * F.lit(c.gpu_per_row + c.h2d_per_row) + F.col("partition_fanout") * F.lit(c.launch_per_partition) + F.col("max_partition_rows") * F.lit(c.serial_per_row)
    return metrics.withColumn("cpu_ns", cpu).withColumn("gpu_ns", gpu).withColumn("route", F.when(F.col("gpu_ns") < F.col("cpu_ns"), "gpu").otherwise("cpu"))


def slope(x, y):
    """Least squares through the origin; null without signal."""
    return F.sum(x * y) / F.nullif(F.sum(x * x), F.lit(0))


def fit(log: DataFrame, prior: Coefficients | None = None) -> DataFrame:
    """One row of coefficients from observations: rows, cpu_ns, and gpu_h2d_ns and gpu_kernel_ns where known.  What has no signal stays."""
    p = prior or Coefficients()
    rows = F.col("rows").cast("double")
    known = lambda c: F.when(F.col(c).isNotNull(), rows)

    def fitted(column: str, least: float, before: float):
        found = slope(known(column), F.col(column).cast("double"))
        return F.when(found.isNotNull(), F.greatest(F.lit(least), found)).otherwise(F.lit(before))

    return log.agg(
        fitted("cpu_ns", 1e-3, p.cpu_per_row).alias("cpu_per_row"),
        fitted("gpu_kernel_ns", 1e-4, p.gpu_per_row).alias("gpu_per_row"),
        fitted("gpu_h2d_ns", 1e-3, p.h2d_per_row).alias("h2d_per_row"),
    )


def append_log(spark: SparkSession, path: str, observation: dict) -> None:
    """Add an observation as a line of JSON."""
    spark.createDataFrame([(json.dumps(observation),)], "value string").coalesce(1).write.mode("append").text(path)


def as_json(c: Coefficients) -> str:
    return json.dumps(asdict(c), indent=2)
