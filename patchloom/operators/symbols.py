"""Which symbol a line or a range of lines belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODULE = "<module>"


def enclosing_symbols(ranges: DataFrame, symbols: DataFrame, scope: list[str], path: str, key: list[str], none: str = MODULE) -> DataFrame:
    """ranges with symbol and symbol_kind: of the symbols that overlap line_start..line_end the one that starts last.

    Both sides join on scope and path, so this is an equi join with a range condition; the choice
    is a mergeable aggregate over narrow rows, joined back by key. Ties go to the symbol that was stored
    first, by symbol_id, and where symbols have none to the least name.
    """
    stored = F.col("symbol_id") if "symbol_id" in symbols.columns else F.lit(0)
    s = symbols.select(
        *scope, F.col("rel_path").alias(path), F.col("qualified_name"), F.col("kind"),
        F.col("line_start").alias("s_start"), F.col("line_end").alias("s_end"), stored.cast("long").alias("s_stored"),
    ).distinct()
    narrow = ranges.select(*dict.fromkeys([*scope, path, *key]), "line_start", "line_end")
    over = narrow.join(s, [*scope, path]).where("s_start <= line_end and s_end >= line_start")
    order = F.struct(-F.col("s_start"), "s_stored", "qualified_name", "kind")
    innermost = over.groupBy(*key).agg(F.min_by(F.struct("qualified_name", "kind"), order).alias("s"))
    joined = ranges.join(innermost.select(*key, "s"), key, "left")
    return joined.withColumn("symbol", F.coalesce("s.qualified_name", F.lit(none))).withColumn("symbol_kind", F.coalesce("s.kind", F.lit("module"))).drop("s")
