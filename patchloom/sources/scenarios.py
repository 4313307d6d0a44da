"""Inputs of a given size for budgets and pruning, made where they are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def large_modules(spark: SparkSession, files: int = 20, functions: int = 16, statements: int = 48) -> DataFrame:
    """(file_path, source) of modules that hold no secret and no keyword of a rule: about 22 000 characters each by default.

    One stays under the size from which a file's diff is summarised; twenty together exceed a context.
    """
    step = "    x = x + 1\n    x = x * 2\n"
    name = F.lpad(F.col("id").cast("string"), 2, "0")

    def body(k):
        return F.concat(F.lit("def fn_"), name, F.lit("_"), F.lpad(k.cast("string"), 2, "0"), F.lit("(x: int) -> int:\n"), F.repeat(F.lit(step), statements), F.lit("    return x\n"))

    source = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(functions - 1)), body), "\n")
    return spark.range(files).select(F.concat(F.lit("mod_"), name, F.lit(".py")).alias("file_path"), source.alias("source"))


def added_diffs(modules: DataFrame, review_id: str) -> DataFrame:
    """(review_id, raw): the diff of a commit that adds the files of modules, one row a file."""
    lines = F.split(F.regexp_replace("source", "\n$", ""), "\n")
    head = F.concat(F.lit("diff --git a/"), F.col("file_path"), F.lit(" b/"), F.col("file_path"), F.lit("\nnew file mode 100644\n--- /dev/null\n+++ b/"), F.col("file_path"))
    hunk = F.concat(F.lit("\n@@ -0,0 +1,"), F.size(lines).cast("string"), F.lit(" @@\n+"))
    return modules.select(F.lit(review_id).alias("review_id"), F.concat(head, hunk, F.array_join(lines, "\n+")).alias("raw"))
