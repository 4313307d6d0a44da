"""Versioned tables of index runs: append, latest-wins upsert, delete, point reads.

A store is a folder of Parquet tables partitioned by repository and snapshot. Data is written
first and the run's row last, so a run that broke off is never taken for an indexed one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = ["repo_path", "git_hash"]
TABLES = ["file_entries", "symbols", "call_edges", "import_edges"]
LEGACY_COLUMNS = ["summary", "embedding"]


def upserted(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """old with new's rows over it, by keys; the columns in keep stay as they were first written.

    Later rows of one side win over earlier ones by `seq`, which both sides carry.
    """
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    order = F.struct("_side", "seq")
    rest = [c for c in old.columns if c not in keys]
    # The columns go through the aggregates in structs, so that a null last value stays a null.
    last = F.max_by(F.struct(*rest), order).alias("_last")
    first = F.min_by(F.struct(*rest), order).alias("_first")
    side = {c: "_first" if c in (keep or []) else "_last" for c in rest}
    return both.groupBy(*keys).agg(last, first).select(*[F.col(c) if c in keys else F.col(f"{side[c]}.{c}").alias(c) for c in old.columns])


def latest_rows(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def indexed(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (repo_path, git_hash) with `is_indexed`."""
    there = runs.select(RUN).distinct().withColumn("is_indexed", F.lit(True))
    return wanted.join(there, RUN, "left").withColumn("is_indexed", F.coalesce("is_indexed", F.lit(False)))


def with_edges(runs: DataFrame, calls: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """The runs that have a call or an import edge."""
    edges = calls.select(RUN)
    if imports is not None:
        edges = edges.unionByName(imports.select(RUN))
    return runs.join(edges, RUN, "left_semi")


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def holds(self, name: str) -> bool:
        """Whether the table was ever written."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)

    def write(self, name: str, rows: DataFrame) -> None:
        """Rows of one or more snapshots; what the table held of them is replaced, all else stays."""
        rows.write.mode("overwrite").partitionBy(*RUN).option("partitionOverwriteMode", "dynamic").parquet(f"{self.folder}/{name}")

    def publish(self, runs: DataFrame) -> None:
        """Make runs visible; call after their data is written."""
        runs.write.mode("append").parquet(f"{self.folder}/index_runs")

    def runs(self) -> DataFrame:
        """One row a snapshot: that of its last publication, unless it was deleted since."""
        rows = self.spark.read.option("mergeSchema", "true").parquet(f"{self.folder}/index_runs")
        row = F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.col("indexed_at")).alias("_row")
        return rows.groupBy(*RUN).agg(row).select("_row.*").where("file_count >= 0")

    def read(self, name: str) -> DataFrame:
        """A table's rows of published snapshots; columns of older versions are dropped."""
        rows = self.spark.read.option("mergeSchema", "true").parquet(f"{self.folder}/{name}").drop(*LEGACY_COLUMNS)
        return rows.join(self.runs().select(RUN), RUN, "left_semi")

    def file(self, repo_path: str, git_hash: str, rel_path: str) -> DataFrame:
        run = (F.col("repo_path") == repo_path) & (F.col("git_hash") == git_hash)
        return self.read("file_entries").where(run & (F.col("rel_path") == rel_path))

    def delete(self, runs: DataFrame) -> None:
        """Hide snapshots from every table: a row with a negative file count is published over theirs."""
        gone = runs.select(*RUN, F.current_timestamp().cast("timestamp_ntz").alias("indexed_at"), F.lit(-1).alias("file_count"))
        self.publish(gone)
