"""What every part needs of a Spark session."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


#: Rows of an Arrow batch, unless the session says otherwise: rows may be texts, and a batch is held by the JVM and by Python.
BATCH_ROWS = 2048


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a context: their Python workers may run where it is not installed."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's own default
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_lotwise_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="lotwise-"), "lotwise.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("lotwise", os.path.relpath(path, root)))
    sc.addPyFile(out)
    sc._lotwise_shipped = True


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares; only where none is named and all runs on one machine, as in tests, in a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lotwise-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
