"""Streaming queries over the events table, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources.tables import table
from ..streaming.findings import sessions, severity_per_window


def _drained(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """All that a stream gives until its input ends, written by it to the shared folder."""
    at = f"{shared_dir(spark)}/patchloom/{label}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={n}")

    query = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{at}/out")
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).scalar()).drop("batch")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(fixed).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    severity = F.when(F.col("value") >= 100, "high").when(F.col("value") >= 20, "medium").otherwise("low")
    return rows.select("user_id", F.col("ts").cast("timestamp").alias("at"), severity.alias("severity"))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each day and grade, counted as a stream."""
    rows = _drained(spark, severity_per_window(_events(spark, sf_dir), "at", "1 day"), "windows")
    return rows.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "severity", "n_findings", F.col("gravest").cast("int").alias("gravest"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user with at most a day between events."""
    rows = _drained(spark, sessions(_events(spark, sf_dir), "user_id", "at", "1 day"), "sessions")
    return rows.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"))


QUERIES = {"stream_windows": stream_windows, "stream_sessions": stream_sessions}

_GRADE = "CASE WHEN value >= 100 THEN 'high' WHEN value >= 20 THEN 'medium' ELSE 'low' END"
SQL = {
    "stream_windows": f"""SELECT strftime(ts, '%Y-%m-%d') AS day, {_GRADE} AS severity, count(*) AS n_findings,
        max(CASE {_GRADE} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END)::INT AS gravest FROM events GROUP BY ALL""",
    "stream_sessions": """WITH x AS (SELECT user_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 DAY THEN 0 ELSE 1 END AS f FROM events)
        SELECT user_id, CAST(sum(f) AS BIGINT) AS n_sessions, count(*) AS n_events FROM x GROUP BY user_id""",
}
