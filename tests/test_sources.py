import subprocess

import pytest

from patchloom.functions.paths import is_ignored, is_irrelevant, is_test_path, language, module_name, path_key
from patchloom.operators.diffs import file_sections
from patchloom.sources import files, history
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=T", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    (root / "calc.py").write_text("def add(a, b):\n    return a + b\n")
    run("add", ".")
    run("commit", "-qm", "first\n\nbody")
    (root / "calc.py").write_text("def add(a, b):\n    return a + b\n\ndef mul(a, b):\n    return a * b\n")
    (root / "bin.dat").write_bytes(b"\x00\xff\n\xfe")
    run("add", ".")
    run("commit", "-qm", "second")
    return str(root)


def test_commits(spark, repo, rows_of):
    history.register(spark)
    df = spark.read.format("git_commits").option("repo", repo).load()
    got = {r.subject: r for r in df.collect()}
    assert got["first"].parent is None and got["first"].message == "first\n\nbody" and got["first"].changed_files == ["calc.py"]
    assert got["second"].parent == got["first"].commit and sorted(got["second"].changed_files) == ["bin.dat", "calc.py"]
    sections = file_sections(df.select(F.col("commit").alias("review_id"), "raw"))
    assert rows_of(sections.where(F.col("review_id") == got["second"].commit), "file_path") == [("bin.dat",), ("calc.py",)]
    assert spark.read.format("git_commits").option("repo", repo).option("limit", 1).load().count() == 1


def test_tree_of_a_commit(spark, repo):
    history.register(spark)
    got = {r.rel_path: r.source for r in spark.read.format("git_tree").option("repo", repo).option("ref", "HEAD~1").load().collect()}
    assert list(got) == ["calc.py"] and "mul" not in got["calc.py"]


def test_resolve(repo, tmp_path):
    assert len(history.resolve(repo)) == 40 and history.resolve(repo, "nope") is None and history.resolve(str(tmp_path)) is None


def test_working_tree(spark, tmp_path, rows_of):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_bytes(b"x = 1\xff\n")
    (tmp_path / "src" / "a.pyc").write_bytes(b"")
    (tmp_path / "node_modules" / "b.js").write_text("")
    got = files.working_tree(spark, str(tmp_path)).collect()
    assert [(r.rel_path, r.language, r.byte_count, r.source) for r in got] == [("src/a.py", "python", 7, "x = 1�\n")]


def test_reports_and_frameworks(spark, tmp_path, rows_of):
    (tmp_path / "rev-1.bandit.json").write_text("{}")
    assert rows_of(files.scanner_reports(spark, str(tmp_path))) == [("rev-1", "bandit", "{}")]
    entries = spark.createDataFrame([("p", "setup.cfg"), ("p", "pytest.ini"), ("p", "package.json")], "repo_path string, rel_path string")
    markers = spark.createDataFrame([("pytest.ini", "pytest", "pytest -q", 0), ("setup.cfg", "pytest", "pytest", 1), ("package.json", "npm", "npm test", 0)], "file_name string, framework string, command string, priority int")
    assert rows_of(files.frameworks(entries, markers)) == [("p", "npm", "npm test"), ("p", "pytest", "pytest -q")]


@pytest.mark.parametrize(
    ("path", "lang", "test", "skip", "ignored", "module"),
    [
        ("a/b.PY", "python", False, False, False, ""), ("tests/x.py", "python", True, False, False, "tests.x"), ("./test_a.py", "python", True, False, False, "..test_a"),
        ("pkg/__init__.py", "python", False, False, False, "pkg"), ("x.md", None, False, True, False, ""), (".py", None, False, False, False, ""),
        ("dist/a.js", "javascript", False, False, True, ""), ("a.tsx", "tsx", False, False, False, ""), ("conftest.py", "python", True, False, False, "conftest"), (None, None, False, False, False, ""),
    ],
)
def test_paths(spark, path, lang, test, skip, ignored, module):
    p = F.col("p")
    row = spark.createDataFrame([(path,)], "p string").select(language(p), is_test_path(p), is_irrelevant(p), is_ignored(p), module_name(p)).first()
    assert tuple(row)[:4] == (lang, test, skip, ignored)
    if path and not path.startswith("."):
        assert row[4] == module


def test_path_key(spark):
    got = [r[0] for r in spark.createDataFrame([("./a",), (".env",), ("../x",)], "p string").select(path_key(F.col("p"))).collect()]
    assert got == ["a", "env", "x"]
