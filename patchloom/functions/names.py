"""One notation for paths and qualified names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def same_path(path: Column) -> Column:
    r"""`\` as `/`, repeated `/` as one, leading `./` dropped."""
    slashes = F.regexp_replace(F.translate(path, "\\", "/"), "/{2,}", "/")
    other = F.contains(path, F.lit("\\")) | F.contains(path, F.lit("//")) | F.startswith(path, F.lit("./"))
    return F.when(other, F.regexp_replace(slashes, r"^(?:\./)+", "")).otherwise(path)


def same_name(name: Column) -> Column:
    """`::` and `#` as `.`, outer blanks and then a final `()` dropped."""
    dotted = F.regexp_replace(name, "::|#", ".")
    other = F.rlike(name, F.lit(r"::|#|^\s|[\s)]$"))
    return F.when(other, F.regexp_replace(F.regexp_replace(dotted, r"^\s+|\s+$", ""), r"\(\)$", "")).otherwise(name)
