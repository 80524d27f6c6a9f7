"""From raw documents to token ids: quality, lines, near-copies, mix, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import bpe, lines, mixing, near, quality
from lotwise.llm.common import count_words, number_rows, store, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _of_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Numbered docs with the few columns of rows (row2, ...); only the small side is hashed."""
    return docs.join(rows.hint("shuffle_hash"), F.col("row") == F.col("row2"))


def _numbered(docs: DataFrame) -> DataFrame:
    """docs come from files, so a second read gives every row its number again."""
    return number_rows(docs.select(*COLUMNS))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules reject go."""
    numbered = _numbered(docs)
    stay = quality.judge(numbered.select("row", "text"), carry=["row"]).where("kept").select(F.col("row").alias("row2"))
    return _of_rows(numbered, stay).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, near-copies included, and documents of which no word is left with them."""
    left = lines.dedup_lines(docs, keep=["doc_id", "lang", "source"])
    some = (F.col("n_exact") + F.col("n_near") == 0) | (count_words("text") > 0)
    return left.where(some).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies the document of the smallest id stays: SimHash candidates, linked at a Jaccard similarity of 0.8 or more of their five-word shingles."""
    numbered = _numbered(docs)
    keyed = numbered.select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row").alias("key"), "text")
    groups = near.near_groups(keyed, key="key", shingle=5)
    stay = groups.where(F.col("key") == F.col("component_id")).select(F.col("key.row").alias("row2"))
    return _of_rows(numbered, stay).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    numbered = _numbered(docs)
    mixed = mixing.mix(numbered, keep=["row"]).where("copies > 0").select(F.col("row").alias("row2"), F.col("copies").cast("int").alias("copies"))
    return _of_rows(numbered, mixed).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; exact says whether they decode to its text."""
    coded = bpe.bpe_encode(docs.select(*COLUMNS), ids="token_ids", decoded="decoded")
    return coded.select("doc_id", "lang", "source", "n_chars", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("bpe", encode)]

#: Fingerprints (XXH64), the fitted rules and the vocabulary are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
