import pytest
from pyspark.sql import functions as F

from patchloom.operators.lists import first_distinct
from patchloom.operators.registry import Detector, Registry


def hits(spark, *titles):
    return spark.createDataFrame([(t,) for t in titles], "title string")


def test_order_first_and_last(spark):
    run = lambda inputs: hits(spark, "x")
    registry = Registry([Detector("c", "C", run, ("a", "b")), Detector("a", "A", run), Detector("b", "B", run, ("a",))])
    assert [d.name for d in registry.in_order()] == ["a", "b", "c"] and registry.names() == ["c", "a", "b"]
    assert registry.first().name == "a" and registry.last() == ["c"]
    registry.add(Detector("b", "Other", run))
    assert registry.names() == ["c", "a", "b"] and Registry().first() is None


def test_circles_are_refused(spark):
    run = lambda inputs: hits(spark, "x")
    with pytest.raises(ValueError, match="a, b"):
        Registry([Detector("a", "A", run, ("b",)), Detector("b", "B", run, ("a",))]).in_order()


def test_run_tells_what_happens(spark, rows_of):
    told = []
    registry = Registry([
        Detector("odd", "Odd", lambda inputs: inputs["missing"]),
        Detector("after", "After", lambda inputs: inputs["odd"], ("odd",)),
        Detector("good", "Good", lambda inputs: inputs["texts"].withColumn("line", F.lit(1))),
        Detector("late", "Late", lambda inputs: inputs["good"].select("title"), ("good",)),
    ])
    found = registry.run({"texts": hits(spark, "t")}, lambda name, state: told.append((name, state)))
    assert rows_of(found, "agent", "title", "line") == [("good", "t", 1), ("late", "t", None)]
    assert [state for name, state in told] == ["started", "failed", "started", "failed", "started", "completed", "started", "completed"]


def test_first_distinct(spark, rows_of):
    rows = [("r", "b", 3), ("r", "a", 1), ("r", "b", 0), ("r", "c", 2), ("r", None, 0), ("r", "", 0), (None, "x", 1), ("r", "a", 9)]
    df = spark.createDataFrame(rows, "g string, v string, n int")
    assert rows_of(first_distinct(df, ["g"], "v", F.col("n"), 2), "g", "v", "position") == [(None, "x", 1), ("r", "a", 2), ("r", "b", 1)]
    assert first_distinct(df.limit(0), ["g"], "v", F.col("n"), 2).count() == 0
