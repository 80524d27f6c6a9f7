"""Queries of this folder's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, lines, lm, mixing, quality, simhash, suffixes, topk, urls
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copies among all documents: 4-word shingles, fingerprints linked at 4 or fewer differing bits."""
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=4, bits=4)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality features of every document and the weakly supervised verdict."""
    judged = quality.judge(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return judged.select("doc_id", *quality.FEATURES, "base_failed", "kept", "p_good")


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every byte covered by a 200-byte string that also starts elsewhere removed; digest of the rest."""
    left = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under a model of the training folds, and the exact unigram score."""
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, each document encoded once; a token counts where it begins."""
    return bpe.token_counts(table(spark, sf_dir, "documents"), rule="start").select(
        "doc_id", "section", "start_char", "end_char", F.col("n_tokens").cast("long").alias("n_tokens"), "doc_tokens"
    )


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents deduplicated within one or two edits; digest of the texts left."""
    left = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2("text", 256).alias("kept_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again; digests of both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.bpe_encode(docs, ids="token_ids", decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the rules, else by the trees."""
    return urls.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "p_block")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to their sources' targets by entropy balancing."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_suffixes": op3_suffixes,
    "op4_lm": op4_lm,
    "op5_token_counts": op5_token_counts,
    "op6_lines": op6_lines,
    "op7_bpe": op7_bpe,
    "op8_urls": op8_urls,
    "op9_mixing": op9_mixing,
    "op10_topk": op10_topk,
}

_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, e FROM v) q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""

_SUFFIXES = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, s, md5(substr(h, 2 * s + 1, 400)) AS k FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199)) AS s FROM d)),
t AS (SELECT r, s, lag(s) OVER (PARTITION BY r ORDER BY s) AS p FROM (SELECT r, s, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1),
g AS (SELECT r, s, sum(CASE WHEN s - p <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY s) AS island FROM t),
i AS (SELECT r, min(s) AS a, max(s) + 200 AS b FROM g GROUP BY r, island),
j AS (SELECT i.r, i.a, i.b, coalesce(lag(i.b) OVER (PARTITION BY i.r ORDER BY i.a), 0) AS z FROM i),
c AS (SELECT j.r, sum(b - a) AS gone, count(*) AS spans, string_agg(substr(d.h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS head, max(b) AS last FROM j JOIN d USING (r) GROUP BY j.r)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(c.gone, 0) AS BIGINT) AS n_removed, coalesce(c.spans, 0) AS n_spans,
  sha256(unhex(coalesce(c.head, '') || substr(d.h, 2 * coalesce(c.last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN c USING (r)
"""

ORACLES: dict[str, str] = {"op3_suffixes": _SUFFIXES, "op10_topk": _TOP_K}
