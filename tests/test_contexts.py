import json

import pytest
from pyspark.sql import functions as F

from patchloom.functions import text
from patchloom.operators.budget import fitting_chunks, review_contexts
from patchloom.operators.diffs import added_lines, file_sections
from patchloom.sources.files import told_frameworks
from patchloom.sources.scenarios import added_diffs, large_modules

CHUNK = "review_id string, chunk_id long, file_path string, symbol string, symbol_kind string, diff_text string, line_start int, line_end int"


def contexts(spark, chunks, dependents, sources, diffs, most=16_000):
    out = review_contexts(
        spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(dependents, "review_id string, position int, file_path string"),
        spark.createDataFrame(sources, "review_id string, file_path string, source string"), spark.createDataFrame(diffs, "review_id string, full_diff string"), most,
    )
    return {r.review_id: r.context for r in out.collect()}


def test_dependents_follow_the_entries_while_there_is_room(spark):
    chunks = [("r", n, "a.py", "f", "function", "+x", n, n) for n in (1, 2)]
    dependents = [("r", n, f"d{n:02d}.py") for n in range(1, 13)]
    sources = [("r", f"d{n:02d}.py", "s" * (900 if n % 2 else 0)) for n in range(1, 13)]
    (got,) = contexts(spark, chunks, dependents, sources, [("r", "whole")]).values()
    entry = "### a.py :: function f (L{0}-{0})\n```diff\n+x\n```\n"
    parts = [entry.format(1), entry.format(2), "\n## Dependent files (affected but not changed):\n"]
    parts += [f"### d{n:02d}.py\n```python\n{'s' * 800}\n```\n" for n in (1, 3, 5, 7, 9)]
    assert got == "\n".join(parts)
    tight = contexts(spark, chunks, dependents, sources, [("r", "whole")], most=3_000)["r"]
    assert tight.count("```python") == 3
    assert "Dependent" not in contexts(spark, chunks, dependents, sources, [("r", "whole")], most=1_050)["r"]


def test_a_cut_entry_does_not_count_and_a_bare_review_falls_back(spark):
    chunks = [("r", 1, "a.py", "f", "function", "x" * 5_000, 1, 9)]
    got = contexts(spark, chunks, [("r", 1, "d.py")], [("r", "d.py", "src")], [("r", "whole"), ("bare", "y" * 50), ("none", None)], most=2_000)
    assert got["r"].startswith("### a.py") and "... [truncated]" in got["r"] and "### d.py" in got["r"]
    assert got["bare"] == "y" * 50 and got["none"] == ""
    assert contexts(spark, [], [], [], [("bare", "y" * 50)], most=20) == {"bare": "y" * 20}


@pytest.mark.parametrize(
    ("content", "expected"),
    [("a\nb", "a\nb"), (["a", {"text": "b"}, {"content": "c"}, {"other": 1}, {"text": "", "content": "d"}, "", None], "a\nb\nc\nd\n"), ([], "[]"), ({"x": 1}, '{"x":1}'), (3, "3")],
)
def test_content_texts(spark, content, expected):
    df = spark.createDataFrame([(json.dumps(content),)], "j string").select(F.try_parse_json("j").alias("content"))
    assert df.select(text.content_text("content")).first()[0] == expected


def test_truncation_notes(spark):
    df = spark.createDataFrame([("x" * 8_000,), ("x" * 8_001,), (None,)], "d string")
    notes = [r[0] for r in df.select(text.truncation_note(F.col("d"))).collect()]
    assert notes[0] == notes[2] == "" and "first 8000 chars of 8001" in notes[1]


def test_frameworks_by_markers_and_fallback(spark, rows_of):
    files = [
        ("p", "pytest.ini", ""), ("p", "tox.ini", ""), ("p", "package.json", ""), ("q", "pyproject.toml", "[tool.ruff]"), ("q", "tests/test_a.py", ""), ("r", "pyproject.toml", "[tool.pytest.ini_options]"),
        ("s", "sub/go.mod", ""), ("s", "tests/deep/test_b.py", ""), ("t", "conftest.py", None), ("t", "test/test_c.py", ""),
    ]
    got = rows_of(told_frameworks(spark.createDataFrame(files, "repo_path string, rel_path string, source string")), "repo_path", "framework")
    assert got == [("p", "npm"), ("p", "pytest"), ("q", "pytest"), ("r", "pytest"), ("t", "unittest")]


def test_large_modules_exceed_a_context(spark):
    modules = large_modules(spark).cache()
    sizes = [r[0] for r in modules.select(F.length("source")).collect()]
    assert len(sizes) == 20 and all(20_000 < n < 24_000 for n in sizes) and sum(sizes) // 4 > 100_000
    sections = file_sections(added_diffs(modules, "big"))
    assert sections.select("file_path").distinct().count() == 20
    assert added_lines(sections.where("file_path = 'mod_03.py'"), ["file_path"]).count() == modules.where("file_path = 'mod_03.py'").select(F.size(F.split("source", "\n"))).first()[0] - 1
    chunks = sections.select("review_id", F.monotonically_increasing_id().alias("chunk_id"), "file_path", "diff_text")
    kept = fitting_chunks(chunks, spark.createDataFrame([("big", 100_000)], "review_id string, max_tokens int"))
    assert 0 < kept.where("not kept").count() < 20
