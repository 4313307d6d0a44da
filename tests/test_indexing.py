from patchloom.operators import indexing, store

SOURCE = '''
import os, sys as s
from pkg.mod import thing as t
from . import near

class A:
    @deco
    def m(self):
        def inner():
            return t(1)
        return inner()

async def f():
    os.path.join("a")
    t(2)
'''


def test_python_parsing():
    got = indexing.python_symbols(SOURCE)
    assert [(x[1], x[2]) for x in got] == [("A", "class"), ("A.m", "method"), ("A.m.inner", "method"), ("f", "function")]
    assert got[1][3] == 8  # not the decorator's line
    assert indexing.python_imports(SOURCE) == [("os", None, None, 2), ("sys", None, "s", 2), ("pkg.mod", "thing", "t", 3), ("", "near", None, 4)]
    assert set(indexing.python_calls(SOURCE)) == {("A.m.inner", "t", 10), ("A.m", "inner", 11), ("f", "join", 14), ("f", "t", 15)}
    assert indexing.python_symbols("def (") == [] and indexing.python_imports("def (") == [] and indexing.python_calls("\0") == []


def test_other_languages():
    js = "class A {\n  run() {}\n}\nfunction f(a) {\n  return a;\n}\n"
    assert [(x[1], x[2], x[3], x[4]) for x in indexing.other_symbols(js)] == [("A", "class", 1, 3), ("f", "function", 4, 6)]


def test_extraction(spark, rows_of):
    files = spark.createDataFrame(
        [("p", "h", "a.py", "python", SOURCE), ("p", "h", "x.go", "go", "func main() {\n}\n"), ("p", "h", "bad.py", "python", "def ("), ("p", "h", "n", None, None)],
        "repo_path string, git_hash string, rel_path string, language string, source string",
    )
    assert rows_of(indexing.extract_symbols(files), "rel_path", "qualified_name") == [("a.py", "A"), ("a.py", "A.m"), ("a.py", "A.m.inner"), ("a.py", "f"), ("x.go", "main")]
    assert indexing.extract_imports(files).count() == 4 and indexing.extract_calls(files).count() == 4


ENTRY = "repo_path string, git_hash string, rel_path string, content_hash string, language string"


def test_incremental(spark, rows_of):
    old = spark.createDataFrame([("p", "1", "a", "x", "python"), ("p", "1", "b", "y", "python")], ENTRY)
    new = spark.createDataFrame([("p", "2", "a", "x", "python"), ("p", "2", "b", "z", "python"), ("p", "2", "c", "x", None)], ENTRY)
    states = indexing.compared(new, old)
    assert rows_of(states, "rel_path", "state") == [("a", "unchanged"), ("b", "changed"), ("c", "added")]
    assert rows_of(indexing.counters(states), "n_files", "n_parsed", "n_reused", "n_skipped") == [(3, 1, 1, 1)]
    assert rows_of(indexing.to_parse(new, old), "rel_path") == [("b",), ("c",)]
    symbols = spark.createDataFrame([("p", "1", "a", "f"), ("p", "1", "b", "g")], "repo_path string, git_hash string, rel_path string, name string")
    assert rows_of(indexing.carried_symbols(new, old, symbols)) == [("p", "2", "a", "f")]


def test_latest_run(spark, rows_of):
    runs = spark.createDataFrame([("p", "1", 5), ("p", "2", 9), ("p", "2", 9), ("q", "3", None)], "repo_path string, git_hash string, indexed_at int")
    assert rows_of(indexing.latest_runs(runs), "repo_path", "git_hash") == [("p", "2"), ("q", "3")]


def test_upsert_lets_later_rows_win_and_keeps_the_name(spark, rows_of):
    schema = "k string, name string, kind string, seq int"
    old = spark.createDataFrame([("a", "n", "x", 1), ("b", "n", "x", 1)], schema)
    new = spark.createDataFrame([("a", "m", "y", 1), ("a", "m", None, 2), ("c", "o", "z", 1)], schema)
    assert rows_of(store.upserted(old, new, ["k"], keep=["name"]), "k", "name", "kind") == [("a", "n", None), ("b", "n", "x"), ("c", "o", "z")]


def test_store(spark, rows_of, tmp_path):
    s = store.Store(spark, str(tmp_path))
    entries = "rel_path string, content_hash string, repo_path string, git_hash string"
    s.write("file_entries", spark.createDataFrame([("a", "1", "p", "h1"), ("a", "1", "p", "h2")], entries))
    run = "repo_path string, git_hash string, indexed_at timestamp_ntz, file_count int"
    publish = lambda h, at, n: s.publish(spark.sql(f"select 'p' repo_path, '{h}' git_hash, timestamp_ntz'{at}' indexed_at, {n} file_count"))
    publish("h1", "2024-01-01 00:00:00", 1)
    assert rows_of(s.read("file_entries"), "git_hash") == [("h1",)]  # h2 was never published
    s.write("file_entries", spark.createDataFrame([("b", "2", "p", "h1")], entries))
    assert rows_of(s.read("file_entries"), "rel_path") == [("b",)]
    publish("h2", "2024-01-02 00:00:00", 1)
    assert rows_of(s.read("file_entries"), "rel_path", "git_hash") == [("a", "h2"), ("b", "h1")]
    assert rows_of(s.file("p", "h2", "a"), "content_hash") == [("1",)]
    s.delete(spark.createDataFrame([("p", "h1")], "repo_path string, git_hash string"))
    assert rows_of(s.read("file_entries"), "git_hash") == [("h2",)] and run
