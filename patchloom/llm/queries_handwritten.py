"""Files that were not written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .handwritten import evidence_of, not_handwritten


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_handwritten(table(spark, sf_dir, "file_entries"), table(spark, sf_dir, "file_heads")).select("entry_id")


def p1_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are not hand-written, by repository and kind."""
    files = table(spark, sf_dir, "file_entries")
    kinds = not_handwritten(files, table(spark, sf_dir, "file_heads"))
    owners = files.select("entry_id", "repo_path").dropDuplicates(["entry_id"])
    return kinds.join(owners, "entry_id").groupBy("repo_path", "kind").agg(F.count("*").alias("n_files"))


def p1_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by what speaks for them, with the rows that nothing else speaks for."""
    rows = evidence_of(table(spark, sf_dir, "file_entries"), table(spark, sf_dir, "file_heads")).dropDuplicates(["entry_id"])
    speaks = {"statement": F.col("told").isNotNull(), "path": F.col("named").isNotNull(), **{c: F.col(c) for c in ("minified", "literal", "alike", "spread")}}
    names = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in speaks.items()]))
    each = rows.select(names.alias("names")).select("names", F.explode("names").alias("evidence"))
    return each.groupBy("evidence").agg(F.count("*").alias("n_rows"), F.count_if(F.size("names") == 1).alias("n_alone"))


QUERIES = {"p1_found": p1_found, "p1_kinds": p1_kinds, "p1_evidence": p1_evidence}
SQL: dict[str, str] = {}
