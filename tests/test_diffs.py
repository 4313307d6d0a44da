from patchloom.operators.diffs import added_lines, chunked, file_sections, header_path, hunks, merged_adjacent
from pyspark.sql import functions as F

RAW = """diff --git a/a.py b/a.py
index 1..2 100644
--- a/a.py
+++ b/a.py
@@ -1,2 +1,3 @@
 x
+y
+++ b/other.py
 z
diff --git a/old.bin b/old.bin
deleted file mode 100644
--- a/old.bin
+++ /dev/null
diff --git "a/sp ace.py" "b/sp ace.py"
@@ -1 +1 @@
-a
+b"""


def test_sections(spark, rows_of):
    got = rows_of(file_sections(spark.createDataFrame([("r", RAW), ("blank", " \n"), ("none", None)], "review_id string, raw string")), "review_id", "file_path")
    assert got == [("r", "a.py"), ("r", "old.bin"), ("r", "sp ace.py")]


def test_last_section_of_a_path_holds(spark):
    raw = "diff --git a/x b/x\n@@ -1 +1 @@\n+1\ndiff --git a/x b/x\n@@ -1 +1 @@\n+2"
    (row,) = file_sections(spark.createDataFrame([("r", raw)], "review_id string, raw string")).collect()
    assert row.diff_text.endswith("+2")


def test_header_paths(spark):
    lines = ["diff --git a/x.py b/x.py", "diff --git a/a b.py b/a b.py", 'diff --git "a/q.py" "b/q.py"', r'diff --git "a/\"q\".py" "b/\"q\".py"']
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, l string").orderBy("i").select(header_path(F.col("l"))).collect()]
    assert got == ["x.py", "a b.py", "q.py", '"q".py']


def test_hunks_and_added_lines(spark, rows_of):
    text = "preamble\n@@ -1,3 +10,4 @@ f\n a\n+b\n-c\n d\n\\ No newline at end of file\n@@@ -5,2 -5,2 +40,2 @@@\n+x"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, diff_text string")
    assert rows_of(hunks(df, ["id"]), "id", "hunk", "line_start", "line_end") == [(1, 1, 10, 13), (1, 2, 40, 40)]
    assert rows_of(added_lines(df, ["id"])) == [(1, 11, "b"), (1, 40, "x")]


def _chunk(i, symbol, a, b, text="t"):
    return ("r", i, "f.py", symbol, "function", text, a, b, "" if i % 2 else "src")


CHUNK = "review_id string, chunk_id long, file_path string, symbol string, symbol_kind string, diff_text string, line_start int, line_end int, full_source string"


def test_merge(spark, rows_of):
    df = spark.createDataFrame([_chunk(1, "f", 1, 5, "A"), _chunk(2, "f", 6, 10, "B"), _chunk(3, "g", 20, 30, "C"), _chunk(4, "f", 50, 51, "D")], CHUNK)
    got = rows_of(merged_adjacent(df), "chunk_id", "line_start", "line_end", "diff_text", "full_source")
    assert got == [(1, 1, 10, "A\nB", "src"), (3, 20, 30, "C", None), (4, 50, 51, "D", "src")]


def test_merge_gap(spark, rows_of):
    df = spark.createDataFrame([_chunk(1, "f", 1, 5), _chunk(2, "f", 10, 12), _chunk(3, "f", 18, 19)], CHUNK)
    assert rows_of(merged_adjacent(df), "line_start", "line_end") == [(1, 12), (18, 19)]


def test_chunks_take_the_innermost_symbol(spark, rows_of):
    files = spark.createDataFrame([("r", "a.py", "@@ -4,2 +4,2 @@\n+x\n+y"), ("r", "b.py", "binary")], "review_id string, file_path string, diff_text string")
    symbols = spark.createDataFrame(
        [("r", "a.py", "C", "class", 1, 10), ("r", "a.py", "C.m", "method", 3, 6)],
        "review_id string, rel_path string, qualified_name string, kind string, line_start int, line_end int",
    )
    assert rows_of(chunked(files, symbols), "file_path", "symbol", "line_start", "line_end") == [("a.py", "C.m", 4, 5), ("b.py", "<module>", 0, 0)]
