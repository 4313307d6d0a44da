from pyspark.sql import functions as F

from patchloom.operators.indexing import extract_symbols
from patchloom.operators.store import Store
from patchloom.streaming.findings import first_deliveries, incremental_index

SCHEMA = "repo_path string, git_hash string, rel_path string, language string, content_hash string, source string"


def test_incremental_index(spark, tmp_path, rows_of):
    def arrive(git_hash, *files):
        rows = [("p", git_hash, path, "python", str(hash(source)), source) for path, source in files]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    store, parsed = Store(spark, str(tmp_path / "store")), []

    def parse(files):
        parsed.extend(r.rel_path for r in files.select("rel_path").collect())
        return extract_symbols(files)

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        incremental_index(stream, store, parse, str(tmp_path / "checkpoint")).awaitTermination()

    arrive("h1", ("a.py", "def f(): pass"), ("b.py", "def g(): pass"))
    run()
    assert sorted(parsed) == ["a.py", "b.py"]
    arrive("h2", ("a.py", "def f(): pass"), ("b.py", "def g2(): pass"))
    parsed.clear()
    run()
    assert parsed == ["b.py"]
    assert rows_of(store.read("symbols"), "git_hash", "rel_path", "name") == [("h1", "a.py", "f"), ("h1", "b.py", "g"), ("h2", "a.py", "f"), ("h2", "b.py", "g2")]


def test_repeats_in_a_stream(spark, tmp_path, rows_of):
    rows = spark.createDataFrame([("r", "a", 1), ("r", "a", 1), ("r", "a", 2)], "review_id string, agent string, seq int").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = first_deliveries(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "at")
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows_of(spark.read.parquet(str(tmp_path / "out")), "seq") == [(1,), (2,)]
