"""Session helpers: a local builder for tests and lineage cuts in shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("patchloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset (local runs) a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="patchloom-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: a lineage cut that outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/patchloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_materialised(spark: SparkSession) -> None:
    """Delete what materialise() has written; call when no query that read it is running."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/patchloom")
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once an application, unless they are local and find it where the driver does."""
    context, package = spark.sparkContext, Path(__file__).resolve().parent
    found = [Path(p or ".").resolve() for p in ["", *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]
    if context.applicationId in _SHIPPED or context.master.startswith("local") and package.parent in found:
        return
    archive = Path(tempfile.mkdtemp(prefix="patchloom-")) / "patchloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
