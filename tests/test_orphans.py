import pytest
from pyspark.sql import functions as F

from patchloom.functions.names import same_name, same_path
from patchloom.operators import orphans as ops
from patchloom.operators.orphans import Reference


def find(spark, children, parents, key=("a", "b"), carry=()):
    child = spark.createDataFrame(children, "id long, a string, b string, table_name string, key string, salt int")
    parent = spark.createDataFrame(parents, "a string, b string, has_parent string")
    cols = [F.col(k) for k in key]
    return ops.orphans([Reference("child", child, "id", cols, "parent", parent, cols, [F.col(c) for c in carry])])


def test_missing_null_and_repeated(spark, rows_of):
    children = [(1, "x", "y", "t", "k", 1), (2, "x", "z", "t", "k", 1), (2, "x", "z", "t", "k", 1), (3, None, "y", "t", "k", 1), (4, "", "", None, None, None)]
    parents = [("x", "y", "1"), ("x", "y", "1"), (None, "y", "1")]
    assert rows_of(find(spark, children, parents), "table_name", "row_id") == [("child", 2), ("child", 3), ("child", 4)]


def test_parts_do_not_run_together(spark, rows_of):
    assert rows_of(find(spark, [(1, "ab", "c", "", "", 0)], [("a", "bc", "")]), "row_id") == [(1,)]


def test_hot_key_is_salted(spark, monkeypatch):
    monkeypatch.setattr(ops, "HOT_REFERENCES", 10)
    children = [(i, "x", "gone", "t", "k", 0) for i in range(500)] + [(1000 + i, "x", "y", "t", "k", 0) for i in range(500)]
    assert find(spark, children, [("x", "y", "")]).count() == 500


def test_more_hot_keys_than_are_sent(spark, monkeypatch):
    monkeypatch.setattr(ops, "HOT_REFERENCES", 10)
    monkeypatch.setattr(ops, "HOT_KEYS", 2)
    children = [(1000 * k + i, "x", f"{'gone' if k % 2 else 'held'}{k}", "t", "k", 0) for k in range(6) for i in range(50 + 10 * k)]
    children += children[:20]
    got = find(spark, children, [("x", f"held{k}", "") for k in range(6)])
    assert sorted(r.row_id for r in got.collect()) == sorted({c[0] for c in children if c[2].startswith("gone")})


def test_counts_by_period(spark, rows_of):
    child = spark.createDataFrame([(1, "x"), (2, "x"), (2, "x"), (3, "y"), (4, None)], "id long, a string")
    parent = spark.createDataFrame([("y",)], "a string")
    periods = spark.createDataFrame([("x", "2024-01")], "a string, period string")
    got = ops.orphans_per_period([Reference("child", child, "id", [F.col("a")], "parent", parent, [F.col("a")], [F.col("a")])], periods)
    assert rows_of(got, "table_name", "period", "n_orphans") == [("child", None, 1), ("child", "2024-01", 2)]


def test_empty_tables(spark, rows_of):
    assert find(spark, [], [("x", "y", "")]).count() == 0
    assert rows_of(find(spark, [(1, "x", "y", "", "", 0)], []), "row_id") == [(1,)]


def test_carried_columns(spark, rows_of):
    assert rows_of(find(spark, [(1, "x", "y", "", "", 0)], [], carry=["a"]), "row_id", "a") == [(1, "x")]


@pytest.mark.parametrize(("raw", "path"), [("a\\b", "a/b"), (".//a//b", "a/b"), ("./././a", "a"), ("../a", "../a"), (".env", ".env"), ("", "")])
def test_paths(spark, raw, path):
    assert spark.createDataFrame([(raw,)], "p string").select(same_path(F.col("p"))).first()[0] == path


@pytest.mark.parametrize(("raw", "name"), [("A::b", "A.b"), ("A#b", "A.b"), ("  f() ", "f"), ("f()()", "f()"), ("F", "F"), (None, None)])
def test_names(spark, raw, name):
    assert spark.createDataFrame([(raw,)], "p string").select(same_name(F.col("p"))).first()[0] == name
