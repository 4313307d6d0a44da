from patchloom.operators import graph
from patchloom.operators.symbols import enclosing_symbols

EDGE = "repo_path string, git_hash string, edge_id long, caller_path string, caller_qname string, callee_name string, callee_path string, callee_qname string, line int"
SYMBOL = "repo_path string, git_hash string, symbol_id long, rel_path string, name string, qualified_name string, kind string, line_start int, line_end int"
IMPORT = "repo_path string, git_hash string, rel_path string, module string, imported_name string, alias string, line int"
FILE = "repo_path string, git_hash string, rel_path string"


def test_reverse_dependencies(spark, rows_of):
    edges = spark.createDataFrame([("p", "h", 1, "b.py", "g", "add", "a.py", "add", 3), ("p", "h", 2, "a.py", "f", "add", "a.py", "add", 9), ("p", "other", 3, "z.py", "g", "add", "a.py", "add", 1)], EDGE)
    symbols = spark.createDataFrame([("p", "h", 1, "a.py", "add", "add", "function", 1, 2)], SYMBOL)
    imports = spark.createDataFrame([("p", "h", "c.py", "a", None, None, 1), ("p", "h", "d.py", "b", None, None, 1)], IMPORT)
    changed = spark.createDataFrame([("p", "h", "a.py"), ("p", "h", "a.py")], FILE)
    assert rows_of(graph.reverse_dependencies(edges, changed, symbols), "rel_path") == [("b.py",)]
    assert rows_of(graph.reverse_dependencies(edges, changed, symbols, imports), "rel_path") == [("b.py",), ("c.py",)]


def test_methods_of_one_name_are_not_linked(spark):
    edges = spark.createDataFrame([("p", "h", 1, "b.py", "g", "run", "x.py", "B.run", 3)], EDGE)
    symbols = spark.createDataFrame([("p", "h", 1, "a.py", "run", "A.run", "method", 1, 2), ("p", "h", 2, "x.py", "run", "B.run", "method", 1, 2)], SYMBOL)
    changed = spark.createDataFrame([("p", "h", "a.py")], FILE)
    assert graph.reverse_dependencies(edges, changed, symbols).count() == 0


def test_first_dependents_are_files(spark, rows_of):
    deps = spark.createDataFrame([("p", "h", f"f{i:02}.py") for i in range(20)], FILE)
    files = spark.createDataFrame([("p", "h", f"f{i:02}.py") for i in range(2, 20)], FILE)
    got = rows_of(graph.first_dependents(deps, files), "rel_path", "position")
    assert got[0] == ("f02.py", 1) and len(got) == 15


def test_module_files(spark, rows_of):
    modules = spark.createDataFrame([("p", "h", "x"), ("p", "h", "y.z"), ("p", "h", "none")], "repo_path string, git_hash string, module string")
    files = spark.createDataFrame([("p", "h", "x.py"), ("p", "h", "x/__init__.py"), ("p", "h", "y/z.py")], FILE)
    assert rows_of(graph.module_files(modules, files), "module", "rel_path") == [("none", None), ("x", "x/__init__.py"), ("y.z", "y/z.py")]


def test_calls_resolve_to_the_own_file_first(spark, rows_of):
    calls = spark.createDataFrame([("p", "h", "a.py", "f", "g", 1), ("p", "h", "a.py", "f", "imp", 2), ("p", "h", "a.py", "f", "nowhere", 3)], "repo_path string, git_hash string, caller_path string, caller_qname string, callee_name string, line int")
    symbols = spark.createDataFrame([("p", "h", 1, "a.py", "g", "g", "function", 1, 2), ("p", "h", 2, "m.py", "orig", "orig", "function", 1, 2)], SYMBOL)
    imports = spark.createDataFrame([("p", "h", "a.py", "m", "orig", "imp", 1)], IMPORT)
    files = spark.createDataFrame([("p", "h", "a.py"), ("p", "h", "m.py")], FILE)
    got = rows_of(graph.resolved_calls(calls, symbols, imports, files), "callee_name", "callee_path", "callee_qname")
    assert got == [("g", "a.py", "g"), ("imp", "m.py", "orig"), ("nowhere", None, None)]


def test_innermost_symbol(spark, rows_of):
    ranges = spark.createDataFrame([(1, "p", "a", 4, 5), (2, "p", "a", 2, 5), (3, "p", "a", 10, 12), (4, "p", "none", 1, 1)], "id int, scope string, path string, line_start int, line_end int")
    symbols = spark.createDataFrame([("p", "a", "C", "class", 1, 9), ("p", "a", "C.m", "method", 3, 6)], "scope string, rel_path string, qualified_name string, kind string, line_start int, line_end int")
    got = rows_of(enclosing_symbols(ranges, symbols, ["scope"], "path", ["id"]), "id", "symbol")
    assert got == [(1, "C.m"), (2, "C.m"), (3, "<module>"), (4, "<module>")]


def test_empty(spark):
    edges, symbols, files = (spark.createDataFrame([], s) for s in (EDGE, SYMBOL, FILE))
    assert graph.reverse_dependencies(edges, files, symbols).count() == 0
    assert graph.graph_stats(symbols, edges).count() == 0
    assert graph.symbol_overview(symbols).count() == 0
