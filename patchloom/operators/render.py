"""Reviews as JSON and as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import title_case


def review_json(verdicts: DataFrame, findings: DataFrame) -> DataFrame:
    """(review_id, json): a verdict with its findings by agent, each report a list in order of seq.

    The reports are nested here, at the sink, and only here; one review is one value.
    """
    fields = ["seq", "category", "severity", "title", "description", "file_path", "line_start", "line_end", "evidence", "recommendation", "confidence"]
    reports = findings.groupBy("review_id", "agent").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("findings"))
    by_agent = reports.groupBy("review_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("agent", "findings")))).alias("agent_reports"))
    joined = verdicts.join(by_agent, "review_id", "left")
    return joined.select("review_id", F.to_json(F.struct(*[c for c in joined.columns])).alias("json"))


def finding_line(position: Column) -> Column:
    place = F.when(F.col("file_path") != "", F.concat(F.lit(" ("), F.col("file_path"), F.coalesce(F.concat(F.lit(":"), F.col("line_start").cast("string")), F.lit("")), F.lit(")")))
    return F.concat(
        position.cast("string"), F.lit(". ["), F.upper(F.coalesce("severity", F.lit(""))), F.lit("] "), title_case(F.coalesce("category", F.lit(""))), F.lit(": "),
        F.coalesce("title", F.lit("")), F.coalesce(place, F.lit("")),
    )


def review_text(verdicts: DataFrame, table: DataFrame) -> DataFrame:
    """(review_id, text): a verdict and the rows of its findings table, in order."""
    rows = table.groupBy("review_id").agg(F.array_sort(F.collect_list(F.struct("position", finding_line(F.col("position")).alias("line")))).alias("rows"))
    head = F.concat(F.lit("Recommendation: "), F.col("recommendation"), F.lit("\nSeverity: "), F.col("overall_severity"), F.lit("\nFindings: "), F.col("n_findings").cast("string"))
    body = F.array_join(F.transform(F.coalesce("rows", F.array().cast("array<struct<position:int,line:string>>")), lambda r: r["line"]), "\n")
    return verdicts.join(rows, "review_id", "left").select("review_id", F.rtrim(F.concat(head, F.lit("\n"), body)).alias("text"))


def suite_json(scores: DataFrame, total: DataFrame) -> DataFrame:
    """(json): one line a scenario and a last one for the suite."""
    rows = scores.select(F.to_json(F.struct(*scores.columns)).alias("json"))
    return rows.unionByName(total.select(F.to_json(F.struct(*total.columns)).alias("json")))
