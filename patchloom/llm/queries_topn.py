"""Top findings of every agent report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import bounded_confidence, lenient_severity_weight
from ..sources.tables import table
from .topn import top_n


def _top_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = table(spark, sf_dir, "findings")
    score = [lenient_severity_weight(F.col("severity")), bounded_confidence(F.col("confidence"))]
    return top_n(findings, ["review_id", "agent"], score, "seq", 5).withColumn("seq", F.col("seq").cast("int"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top_five(spark, sf_dir).select("review_id", "agent", "seq")


def p5_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top_five(spark, sf_dir).withColumn("position", F.col("position").cast("int"))


QUERIES = {"p5_found": p5_found, "p5_ranked": p5_ranked}

_RANKED = """
WITH one AS (
  SELECT review_id, agent, seq,
    max({'w': CASE lower(trim(severity, ' ')) WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END,
         'c': CASE WHEN confidence IS NULL OR isnan(confidence) OR confidence < 0 OR confidence > 1 THEN 0.0 ELSE confidence END}) AS s
  FROM findings GROUP BY ALL)
SELECT review_id, agent, seq, CAST(row_number() OVER (PARTITION BY review_id, agent ORDER BY s.w DESC, s.c DESC, seq) AS INTEGER) AS position
FROM one QUALIFY position <= 5
"""
SQL = {"p5_found": f"SELECT review_id, agent, seq FROM ({_RANKED})", "p5_ranked": _RANKED}
