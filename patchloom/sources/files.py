"""Working trees and report folders as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import is_ignored, language
from ..functions.text import content_hash


def working_tree(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, language, content_hash, mtime, byte_count, source) of the files under root, ignored folders left out.

    Bytes that are not UTF-8 become U+FFFD.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + "\\Q" + base + "\\E/", "")
    source = F.make_valid_utf8(F.col("content").cast("string"))
    rows = files.select(path.alias("rel_path"), F.unix_micros("modificationTime").alias("m"), F.col("length").alias("byte_count"), source.alias("source"))
    return rows.where(~is_ignored(F.col("rel_path"))).select(
        "rel_path", language(F.col("rel_path")).alias("language"), content_hash(F.col("source")).alias("content_hash"),
        (F.col("m") / 1e6).alias("mtime"), "byte_count", "source",
    )


def scanner_reports(spark: SparkSession, folder: str) -> DataFrame:
    """(review_id, tool, raw) of report files named REVIEW.TOOL.json in folder."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(name.alias("name"), F.col("value").alias("raw"))
    return rows.select(F.regexp_extract("name", r"^(.*)\.[^.]+$", 1).alias("review_id"), F.regexp_extract("name", r"([^.]+)$", 1).alias("tool"), "raw")


# Files that tell a test framework, in the order in which they count.
MARKERS = [
    ("pytest", "pytest.ini", "pytest -x --tb=short"), ("pytest", "pyproject.toml", "pytest -x --tb=short"), ("pytest", "setup.cfg", "pytest -x --tb=short"),
    ("pytest", "tox.ini", "pytest -x --tb=short"), ("unittest", "conftest.py", "python -m pytest -x --tb=short"), ("npm", "package.json", "npm test"),
    ("go", "go.mod", "go test ./..."), ("cargo", "Cargo.toml", "cargo test"), ("rake", "Rakefile", "rake test"),
]
#: A marker that counts only if it speaks of its framework.
MUST_SAY = {"pyproject.toml": "pytest"}
FALLBACK = ("pytest", "pytest -x --tb=short")


def told_frameworks(files: DataFrame) -> DataFrame:
    """(repo_path, framework, command) of trees (repo_path, rel_path, source): the first marker at the root that tells each framework,
    or else pytest where tests/ or test/ holds test_*.py."""
    tells = F.lit(None).cast("struct<framework:string,command:string,priority:int>")
    for n, (framework, name, command) in reversed(list(enumerate(MARKERS))):
        said = F.contains(F.coalesce("source", F.lit("")), F.lit(MUST_SAY[name])) if name in MUST_SAY else F.lit(True)
        tells = F.when((F.col("rel_path") == name) & said, F.struct(F.lit(framework).alias("framework"), F.lit(command).alias("command"), F.lit(n).alias("priority"))).otherwise(tells)
    rows = files.select("repo_path", tells.alias("t"), F.rlike("rel_path", F.lit("^tests?/test_[^/]*[.]py$")).alias("is_test"))
    found = rows.where("t is not null").groupBy("repo_path", "t.framework").agg(F.min_by("t.command", "t.priority").alias("command"))
    bare = rows.groupBy("repo_path").agg(F.bool_or("is_test").alias("tested"), F.max(F.col("t").isNotNull()).alias("told")).where("tested and not told")
    return found.unionByName(bare.select("repo_path", F.lit(FALLBACK[0]).alias("framework"), F.lit(FALLBACK[1]).alias("command")))


def frameworks(files: DataFrame, markers: DataFrame) -> DataFrame:
    """(repo_path, framework, command): the first marker file by priority of each framework; markers: file_name, framework, command, priority."""
    named = files.withColumn("file_name", F.regexp_extract("rel_path", r"([^/]+)$", 1))
    found = named.join(markers, "file_name")
    return found.groupBy("repo_path", "framework").agg(F.min_by("command", F.struct("priority", "rel_path")).alias("command"))
