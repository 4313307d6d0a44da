"""Ordinal weights of severities, recommendations and agents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SEVERITY_WEIGHT = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}
RECOMMENDATION_RANK = {"approve": 0, "request_changes": 1, "block": 2}
AGENT_PRIORITY = {"security": 0, "code_quality": 1, "test": 2, "index": 3}
#: An orchestrator of its own, and every other agent, comes after the detectors.
OTHER_AGENT = 99


def _lookup(col: Column, values: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for key, value in values.items():
        out = F.when(col == key, value).otherwise(out)
    return F.coalesce(out, F.lit(default))


def severity_weight(severity: Column) -> Column:
    """Weight of a severity; unknown and null weigh 0."""
    return _lookup(severity, SEVERITY_WEIGHT, 0)


def lenient_severity_weight(severity: Column) -> Column:
    """As severity_weight, with outer blanks and case ignored."""
    return severity_weight(F.lower(F.trim(severity)))


def recommendation_rank(recommendation: Column) -> Column:
    return _lookup(recommendation, RECOMMENDATION_RANK, 0)


def agent_priority(agent: Column) -> Column:
    return _lookup(agent, AGENT_PRIORITY, OTHER_AGENT)


def bounded_confidence(confidence: Column) -> Column:
    """Confidence as a number from 0 to 1; null, NaN and anything outside count as 0."""
    ok = confidence.isNotNull() & ~F.isnan(confidence) & confidence.between(0.0, 1.0)
    return F.when(ok, confidence + F.lit(0.0)).otherwise(F.lit(0.0))
