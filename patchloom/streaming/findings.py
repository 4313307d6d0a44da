"""Findings and index runs as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.ranks import severity_weight
from ..operators.indexing import carried_symbols, latest_runs, to_parse
from ..operators.store import Store
from ..session import materialise


def first_deliveries(findings: DataFrame, time: str, lateness: str = "1 hour") -> DataFrame:
    """A stream of findings without repeats; state is dropped once the watermark has passed it."""
    return findings.withWatermark(time, lateness).dropDuplicatesWithinWatermark(["review_id", "agent", "seq"])


def severity_per_window(findings: DataFrame, time: str, window: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """(window, severity, n_findings, gravest) of event-time windows; late rows within the watermark count."""
    rows = findings.withWatermark(time, lateness).groupBy(F.window(time, window), "severity")
    return rows.agg(F.count("*").alias("n_findings"), F.max(severity_weight(F.col("severity"))).alias("gravest"))


def sessions(events: DataFrame, key: str, time: str, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """(key, session, n): runs of events with at most a gap between them."""
    return events.withWatermark(time, lateness).groupBy(key, F.session_window(time, gap).alias("session")).agg(F.count("*").alias("n"))


def incremental_index(files: DataFrame, store: Store, parse, checkpoint: str) -> StreamingQuery:
    """Index snapshots as they arrive: only contents that the repository's latest stored snapshot lacks are parsed.

    files: a stream of file_entries rows with their source. Each micro-batch is written first and
    its runs are published last; a batch that is run again replaces its own partitions.
    """

    def index(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            known, carried = batch.limit(0), None
            if store.holds("index_runs"):
                # A batch that is run again does not compare with what it published itself.
                before = store.runs().join(batch.select("repo_path", "git_hash").distinct(), ["repo_path", "git_hash"], "left_anti")
                known = store.read("file_entries").join(latest_runs(before).select("repo_path", "git_hash"), ["repo_path", "git_hash"], "left_semi")
                carried = carried_symbols(batch, known, store.read("symbols"))
            symbols = parse(to_parse(batch, known))
            if carried is not None:
                symbols = symbols.unionByName(carried.select(symbols.columns))
            # Read before the folder that it is read from is written.
            store.write("symbols", materialise(symbols, "symbols"))
            store.write("file_entries", batch.drop("source"))
            runs = batch.groupBy("repo_path", "git_hash").agg(F.count("*").cast("int").alias("file_count"))
            store.publish(runs.select("repo_path", "git_hash", F.current_timestamp().cast("timestamp_ntz").alias("indexed_at"), "file_count"))
        finally:
            batch.unpersist()

    return files.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
