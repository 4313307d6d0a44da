"""Broken references between the index tables, as queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import same_name, same_path
from ..operators.orphans import Reference, key_of, orphans, orphans_per_period
from ..sources.tables import table


def _run() -> list[Column]:
    return [F.col("repo_path"), F.col("git_hash")]


def index_references(spark: SparkSession, sf_dir: str, carry: list[Column] | None = None) -> list[Reference]:
    """Call edges refer to symbols, symbols refer to files, both within one snapshot."""
    edges = table(spark, sf_dir, "call_edges").where("callee_path <> '' and callee_qname <> ''")
    symbols = table(spark, sf_dir, "symbols")
    files = table(spark, sf_dir, "file_entries")
    symbol_key = [*_run(), same_path(F.col("rel_path")), same_name(F.col("qualified_name"))]
    path_key = [*_run(), same_path(F.col("rel_path"))]
    return [
        Reference(
            "call_edges", edges, "edge_id", [*_run(), same_path(F.col("callee_path")), same_name(F.col("callee_qname"))],
            "symbols", symbols, symbol_key, carry or [],
        ),
        Reference("symbols", symbols, "symbol_id", path_key, "file_entries", files, path_key, carry or []),
    ]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(index_references(spark, sf_dir)).select("table_name", "row_id")


def p3_orphans_per_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table and month of the snapshot's latest indexed_at; null where the snapshot has no run."""
    run = key_of(_run()).alias("run")
    runs = table(spark, sf_dir, "index_runs").groupBy(run).agg(F.date_format(F.max("indexed_at"), "yyyy-MM").alias("period"))
    return orphans_per_period(index_references(spark, sf_dir, [run]), runs)


QUERIES = {"p3_found": p3_found, "p3_orphans_per_month": p3_orphans_per_month}

_PATH = r"regexp_replace(regexp_replace(replace({}, '\', '/'), '/{{2,}}', '/', 'g'), '^(?:\./)+', '')"
_NAME = r"regexp_replace(regexp_replace(regexp_replace({}, '::|#', '.', 'g'), '^\s+|\s+$', '', 'g'), '\(\)$', '')"
_FOUND = f"""
SELECT DISTINCT 'call_edges' AS table_name, e.edge_id AS row_id, e.repo_path, e.git_hash FROM call_edges e
WHERE e.callee_path <> '' AND e.callee_qname <> '' AND NOT EXISTS (
  SELECT 1 FROM symbols s WHERE s.repo_path = e.repo_path AND s.git_hash = e.git_hash
  AND {_PATH.format("s.rel_path")} = {_PATH.format("e.callee_path")}
  AND {_NAME.format("s.qualified_name")} = {_NAME.format("e.callee_qname")})
UNION
SELECT DISTINCT 'symbols', s.symbol_id, s.repo_path, s.git_hash FROM symbols s WHERE NOT EXISTS (
  SELECT 1 FROM file_entries f WHERE f.repo_path = s.repo_path AND f.git_hash = s.git_hash
  AND {_PATH.format("f.rel_path")} = {_PATH.format("s.rel_path")})
"""

SQL = {
    "p3_found": f"SELECT table_name, row_id FROM ({_FOUND})",
    "p3_orphans_per_month": f"""
        WITH runs AS (SELECT repo_path, git_hash, max(indexed_at) AS indexed_at FROM index_runs GROUP BY ALL)
        SELECT table_name, strftime(indexed_at, '%Y-%m') AS period, count(*) AS n_orphans
        FROM ({_FOUND}) o LEFT JOIN runs USING (repo_path, git_hash) GROUP BY ALL""",
}
