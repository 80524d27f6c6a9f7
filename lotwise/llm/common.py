"""What the operators of this folder share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a run of bytes other than space and the controls 09-0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Fixed value: the separators, as a split pattern.
GAP = r"[\x20\x09-\x0D]+"

#: Python sides of Arrow exchanges hand out at most about this many bytes at once.
OUT_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Take the cluster's shared checkpoint folder; only where none is named and all runs on one machine (tests) make one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lotwise-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows from reliable storage: lineage ends here, lost executors do not matter."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a Parquet table in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def number_rows(df: DataFrame, name: str = "row") -> DataFrame:
    """df, read from files or a checkpoint, with a number for each row that a second read gives again.

    Files are split by the cores that are there when a plan is made; that is pinned for the session, so that an executor lost
    between two reads does not move the splits.
    """
    spark = df.sparkSession
    for setting in ("spark.sql.files.minPartitionNum", "spark.sql.leafNodeDefaultParallelism"):
        if spark.conf.get(setting, None) is None:
            spark.conf.set(setting, str(spark.sparkContext.defaultParallelism))
    return df.withColumn(name, F.monotonically_increasing_id())


def words(text: str) -> F.Column:
    """Array of the words of a column, null counted as empty; JVM side."""
    c = F.coalesce(F.col(text), F.lit(""))
    return F.filter(F.split(c, GAP), lambda w: w != "")


def count_words(text: str) -> F.Column:
    """Number of words without building their array of strings twice."""
    c = F.coalesce(F.col(text), F.lit(""))
    parts = F.split(c, GAP)
    # only the first and the last part can be empty
    return (
        F.size(parts)
        - F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
        - F.when((F.element_at(parts, -1) == "") & (F.size(parts) > 1), 1).otherwise(0)
    ).cast("long")


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [b or b"" for b in column.to_pylist()]


def by_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A batch-wise function for mapInArrow; large batches go through in slices of bounded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(batch.num_rows * OUT_BYTES / max(batch.nbytes, OUT_BYTES)))
            for i in range(0, batch.num_rows, step):
                yield f(batch.slice(i, step))

    return run
