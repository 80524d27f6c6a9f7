"""Sinks: tradebooks, packed (clustered) tables, versioned tables, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import KEY, TRADES, validate


def write_tradebook(book: DataFrame, path: str, rows_per_file: int = 8_000_000) -> None:
    book.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).mode("overwrite").parquet(path)


def write_packed(trades: DataFrame, path: str, files: int | None = None) -> None:
    """Clustered by key and sorted, so that row-group statistics prune by client and symbol."""
    ranged = trades.repartitionByRange(files, *KEY, "seq") if files else trades.repartitionByRange(*KEY, "seq")
    ranged.sortWithinPartitions(*KEY, "seq").write.option("compression", "zstd").mode("overwrite").parquet(path)


def write_bucketed(trades: DataFrame, table: str, buckets: int) -> None:
    """A catalog table dealt out by key as matching wants it: queries on it need no exchange before their windows."""
    trades.repartition(buckets, *KEY).write.bucketBy(buckets, *KEY).sortBy(*KEY, "seq").mode("overwrite").saveAsTable(table)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    return validate(spark.read.parquet(path), TRADES)


def _file(spark: SparkSession, path: str):
    """Hadoop's file system and path, so that any store Spark reaches works."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _file(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _file(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    write_text(spark, f"{path}/manifest.json", json.dumps(manifest, indent=2))


def read_manifest(spark: SparkSession, path: str) -> dict:
    try:
        return json.loads(read_text(spark, f"{path}/manifest.json"))
    except FileNotFoundError:
        raise FileNotFoundError(f"{path} has no manifest; generate it first") from None


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, p = _file(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit() and fs.exists(_file(spark, f"{path}/{n}/_SUCCESS")[1]))


def write_version(trades: DataFrame, path: str) -> int:
    """A new version beside the others; the pointer to the latest moves only once its files are whole."""
    spark = trades.sparkSession
    version = max(versions(spark, path), default=0) + 1
    write_packed(trades, f"{path}/v={version}")
    write_text(spark, f"{path}/_latest", str(version))
    return version


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The latest version, or that of a number."""
    if version is None:
        version = int(read_text(spark, f"{path}/_latest"))
    if version not in versions(spark, path):
        raise ValueError(f"{path} has no version {version}")
    return read_packed(spark, f"{path}/v={version}")


def open_source(spark: SparkSession, packed: str | None = None, uri: str | None = None, version: int | None = None) -> DataFrame:
    """A versioned table if ``uri`` names one, else the packed table."""
    if uri:
        return read_version(spark, uri, version)
    if not packed:
        raise ValueError("name a packed table or a versioned one")
    return read_packed(spark, packed)


def partition_starts(trades: DataFrame) -> DataFrame:
    """Boundaries derived from rows alone, where a table has no other record of them."""
    from ..operators.pages import key_changes, with_row_number

    return key_changes(with_row_number(trades)).select(*KEY, F.col("start"))
