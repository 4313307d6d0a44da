"""Credentials in diffs, sources and evidence, and the texts without them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .credentials import find_credentials, redact_credentials


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    def records(name: str, text: str, *key: str) -> DataFrame:
        joined = F.concat_ws("#", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
        return table(spark, sf_dir, name).select(F.lit(name).alias("table_name"), joined.alias("record_key"), F.col(text).alias("text"))

    chunks = records("diff_chunks", "diff_text", "chunk_id")
    sources = records("file_sources", "source", "review_id", "file_path")
    return chunks.unionByName(sources).unionByName(records("findings", "evidence", "review_id", "agent", "seq"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_credentials(_records(spark, sf_dir)).select("table_name", "record_key", "line_no").distinct()


def p4_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_credentials(_records(spark, sf_dir))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_credentials(_records(spark, sf_dir))


QUERIES = {"p4_found": p4_found, "p4_places": p4_places, "p4_redacted": p4_redacted}
SQL: dict[str, str] = {}
