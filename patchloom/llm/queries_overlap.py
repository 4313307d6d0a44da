"""Evaluation items in documents, and long spans that documents share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from .leakage import leaks
from .spans import shared_characters, sharing_pairs


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leak with the number of the item's shingles that the document holds."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("item_id", "doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharing_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_shared_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_characters(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p7_found": p7_found, "p7_leaks": p7_leaks, "p8_found": p8_found, "p8_shared_characters": p8_shared_characters}

_LEAKS = r"""
WITH item_words AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM eval_items),
doc_words AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents),
item_grams AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i+12], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM item_words WHERE len(w) >= 13)),
doc_grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM doc_words WHERE len(w) >= 13))
"""
_GRAMS = """
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 256),
grams AS (SELECT doc_id, i AS pos, md5(substr(text, i, 256)) AS g
          FROM (SELECT doc_id, text, unnest(range(1, length(text) - 254)) AS i FROM docs)),
shared AS (SELECT g FROM grams GROUP BY g HAVING count(DISTINCT doc_id) > 1)
"""
SQL = {
    "p7_found": f"{_LEAKS} SELECT DISTINCT item_id, doc_id FROM item_grams JOIN doc_grams USING (g)",
    "p7_leaks": f"{_LEAKS} SELECT item_id, doc_id, CAST(count(*) AS INTEGER) AS n_shingles FROM item_grams JOIN doc_grams USING (g) GROUP BY ALL",
    "p8_found": f"""{_GRAMS}
        , kept AS (SELECT DISTINCT doc_id, g FROM grams SEMI JOIN shared USING (g))
        SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM kept a JOIN kept b ON a.g = b.g AND a.doc_id < b.doc_id""",
    "p8_shared_characters": f"""{_GRAMS}
        , kept AS (SELECT doc_id, pos, g FROM grams SEMI JOIN shared USING (g)),
        fresh AS (SELECT doc_id, least(256, pos - coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), -256)) AS n FROM kept)
        SELECT doc_id, CAST(sum(n) AS BIGINT) AS shared_chars
        FROM fresh f GROUP BY doc_id""",
}
