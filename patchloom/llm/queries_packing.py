"""Documents of each source in contexts of 2 048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .packing import CAPACITY, pack


def p6_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = pack(table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    return placed.withColumnsRenamed({"id": "doc_id", "owner": "source"})


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of each source, their tokens and the share of room used."""
    by_source = p6_contexts(spark, sf_dir).groupBy("source").agg(
        F.countDistinct("context_id").alias("n_contexts"), F.sum("n_tokens").alias("n_tokens")
    )
    return by_source.withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_contexts") * CAPACITY), 6))


def p6_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document: whether its pieces are all there once, cut only if over the capacity, in contexts of its source within the capacity."""
    placed = p6_contexts(spark, sf_dir)
    room = placed.groupBy("context_id").agg(F.sum("n_tokens").alias("held"), F.countDistinct(F.coalesce("source", F.lit(""))).alias("sources"))
    rows = placed.join(room, "context_id").groupBy("doc_id").agg(
        (F.countDistinct("piece") == F.max("n_pieces")).alias("all"), (F.count("*") == F.max("n_pieces")).alias("once"), F.bool_and((F.col("held") <= CAPACITY) & (F.col("sources") == 1)).alias("fits"),
        F.bool_and((F.col("piece") == F.col("n_pieces") - 1) | (F.col("n_tokens") == CAPACITY)).alias("full"),
    )
    return rows.select("doc_id", (F.col("all") & F.col("once") & F.col("full")).alias("whole"), "fits")


QUERIES = {"p6_contexts": p6_contexts, "p6_fill": p6_fill, "p6_placed": p6_placed}
SQL = {"p6_placed": "SELECT DISTINCT doc_id, TRUE AS whole, TRUE AS fits FROM documents WHERE text <> '' AND doc_id IS NOT NULL"}
