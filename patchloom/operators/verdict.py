"""Verdicts over findings and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import RECOMMENDATION_RANK, SEVERITY_WEIGHT, recommendation_rank, severity_weight

SURE = 0.7


def overall_severity() -> Column:
    """Aggregate: the gravest severity; info for none and for unknown ones."""
    names = F.array(*[F.lit(s) for s, _ in sorted(SEVERITY_WEIGHT.items(), key=lambda x: x[1])])
    return F.element_at(names, (F.coalesce(F.max(severity_weight(F.col("severity"))), F.lit(0)) + 1).cast("int"))


def recommendation(errors: Column | None = None) -> Column:
    """Aggregate: block on a critical finding, request changes on a sure high one, else approve, but never with errors."""
    critical = F.coalesce(F.bool_or(F.col("severity") == "critical"), F.lit(False))
    high = F.coalesce(F.bool_or((F.col("severity") == "high") & (F.col("confidence") >= SURE)), F.lit(False))
    clean = "approve" if errors is None else F.when(errors, "request_changes").otherwise("approve")
    return F.when(critical, "block").when(high, "request_changes").otherwise(clean)


def verdicts(findings: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """(review_id, overall_severity, recommendation, n_findings); failed: review_id of reviews with errors."""
    if failed is None:
        return findings.groupBy("review_id").agg(
            overall_severity().alias("overall_severity"), recommendation().alias("recommendation"), F.count("*").alias("n_findings")
        )
    marked = findings.select("review_id", "severity", "confidence", F.lit(1).alias("n"), F.lit(False).alias("failed")).unionByName(
        failed.select("review_id", F.lit(None).cast("string").alias("severity"), F.lit(None).cast("double").alias("confidence"), F.lit(0).alias("n"), F.lit(True).alias("failed"))
    )
    return marked.groupBy("review_id").agg(
        overall_severity().alias("overall_severity"), recommendation(F.bool_or("failed")).alias("recommendation"), F.sum("n").alias("n_findings")
    )


def stricter(a: Column, b: Column, rank, default: str) -> Column:
    """The stricter of two values; a value without rank, and null, never counts."""
    known = RECOMMENDATION_RANK if rank is recommendation_rank else SEVERITY_WEIGHT
    sound_b = F.when(b.isin(list(known)), b)
    sound_a = F.coalesce(F.when(a.isin(list(known)), a), F.lit(default))
    return F.when(sound_b.isNotNull() & (rank(sound_b) > rank(sound_a)), sound_b).otherwise(sound_a)


def combined(deterministic: DataFrame, proposed: DataFrame) -> DataFrame:
    """Verdicts with the stricter of the rules' and a model's (review_id, severity, recommendation) answer."""
    p = proposed.select("review_id", F.col("overall_severity").alias("p_severity"), F.col("recommendation").alias("p_recommendation"))
    joined = deterministic.join(p, "review_id", "left")
    return joined.withColumn("overall_severity", stricter(F.col("overall_severity"), F.col("p_severity"), severity_weight, "info")).withColumn(
        "recommendation", stricter(F.col("recommendation"), F.col("p_recommendation"), recommendation_rank, "approve")
    ).drop("p_severity", "p_recommendation")


def latest_reports(reports: DataFrame, arrival: str) -> DataFrame:
    """One report for each review and agent, the last to arrive."""
    row = F.struct(*[F.col(c) for c in reports.columns])
    return reports.groupBy("review_id", "agent").agg(F.max_by(row, F.col(arrival)).alias("_row")).select("_row.*")


def distinct_errors(errors: DataFrame) -> DataFrame:
    """(review_id, error, seq): repeated messages of a review once, at their first place."""
    return errors.groupBy("review_id", "error").agg(F.min("seq").alias("seq"))
