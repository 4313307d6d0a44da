"""Diff chunks over the token limit of their review, in pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .splitting import CHARS_PER_TOKEN, OVERLAP_TOKENS, oversized, split_all


def _oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = (
        table(spark, sf_dir, "reviews")
        .groupBy("review_id")
        .agg(F.max(F.struct("ingested_at", "created_at", "max_tokens")).alias("last"))
        .select("review_id", F.col("last.max_tokens").alias("max_tokens"))
    )
    return oversized(table(spark, sf_dir, "diff_chunks"), latest, "chunk_id", "review_id", "diff_text", "max_tokens")


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_all(_oversized(spark, sf_dir))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).withColumnRenamed("id", "chunk_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that came out in pieces."""
    return _pieces(spark, sf_dir).where("piece = 0 and n_pieces > 1").select(F.col("id").alias("chunk_id"))


def p2_reassembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that the pieces of each chunk give without their overlaps, and whether sizes and overlaps are as they must be."""
    limits = _oversized(spark, sf_dir).select("id", "limit")
    fresh = F.substr("text", F.col("fresh") - F.col("start") + 1)
    overlap = F.least(F.lit(CHARS_PER_TOKEN * OVERLAP_TOKENS), CHARS_PER_TOKEN * (F.col("limit") - 1))
    repeats = F.when(F.col("piece") == 0, F.col("fresh") == 0).otherwise(F.col("fresh") - F.col("start") == overlap)
    rows = _pieces(spark, sf_dir).join(limits, "id").groupBy(F.col("id").alias("chunk_id")).agg(
        F.array_sort(F.collect_list(F.struct("piece", fresh.alias("fresh")))).alias("parts"),
        F.bool_and(F.floor(F.length("text") / CHARS_PER_TOKEN) <= F.col("limit")).alias("within_limit"),
        F.bool_and(repeats).alias("overlaps"),
    )
    whole = F.array_join(F.transform("parts", lambda p: p["fresh"]), "")
    return rows.select("chunk_id", F.sha2(whole, 256).alias("text_hash"), "within_limit", "overlaps")


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces, "p2_reassembled": p2_reassembled}

_OVER = """
WITH latest AS (
  SELECT review_id, max_tokens FROM reviews
  QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY ingested_at DESC, created_at DESC, max_tokens DESC NULLS LAST) = 1),
over AS (
  SELECT DISTINCT chunk_id, diff_text FROM diff_chunks LEFT JOIN latest USING (review_id)
  WHERE length(diff_text) // 4 > CASE WHEN max_tokens > 0 THEN max_tokens ELSE 100000 END)
"""
SQL = {
    "p2_found": f"{_OVER} SELECT DISTINCT chunk_id FROM over",
    "p2_reassembled": f"{_OVER} SELECT chunk_id, sha256(diff_text) AS text_hash, TRUE AS within_limit, TRUE AS overlaps FROM over",
}
