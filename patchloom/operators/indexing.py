"""The index of a repository: incremental parsing, symbols, imports and calls."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "repo_path string, git_hash string, rel_path string, name string, qualified_name string, kind string, line_start int, line_end int"
IMPORTS = "repo_path string, git_hash string, rel_path string, module string, imported_name string, alias string, line int"
CALLS = "repo_path string, git_hash string, caller_path string, caller_qname string, callee_name string, line int"


def latest_runs(runs: DataFrame) -> DataFrame:
    """(repo_path, git_hash, indexed_at) of the last run of each repository."""
    last = runs.groupBy("repo_path").agg(F.max_by(F.struct("git_hash", "indexed_at"), F.struct("indexed_at", "git_hash")).alias("x"))
    return last.select("repo_path", "x.git_hash", "x.indexed_at")


def compared(current: DataFrame, previous: DataFrame) -> DataFrame:
    """current with `state`: unchanged, changed or added against previous, by repo_path, rel_path and content_hash."""
    place, content = ["repo_path", "rel_path"], ["repo_path", "rel_path", "content_hash"]
    there = previous.select(*place, F.lit(True).alias("_there")).distinct()
    same = previous.select(*content, F.lit(True).alias("_same")).distinct()
    state = F.when(F.col("_same"), "unchanged").when(F.col("_there"), "changed").otherwise("added")
    return current.join(same, content, "left").join(there, place, "left").withColumn("state", state).drop("_same", "_there")


def to_parse(current: DataFrame, previous: DataFrame) -> DataFrame:
    """The files of current that no file of previous has at the same path with the same content."""
    keys = ["repo_path", "rel_path", "content_hash"]
    return current.join(previous.select(keys).distinct(), keys, "left_anti")


def carried_symbols(current: DataFrame, previous: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols of unchanged files under the current snapshot; symbols are those of previous."""
    keys = ["repo_path", "rel_path", "content_hash"]
    kept = current.select("repo_path", F.col("git_hash").alias("_new"), "rel_path", "content_hash").join(
        previous.select(*keys, F.col("git_hash")), keys
    )
    return symbols.join(kept.drop("content_hash"), ["repo_path", "git_hash", "rel_path"]).withColumn("git_hash", F.col("_new")).select(symbols.columns)


def counters(states: DataFrame) -> DataFrame:
    """(repo_path, git_hash, n_files, n_parsed, n_reused, n_skipped): files without a language are skipped."""
    known = F.col("language").isNotNull()
    return states.groupBy("repo_path", "git_hash").agg(
        F.count("*").alias("n_files"),
        F.count_if(known & (F.col("state") != "unchanged")).alias("n_parsed"),
        F.count_if(known & (F.col("state") == "unchanged")).alias("n_reused"),
        F.count_if(~known).alias("n_skipped"),
    )


def python_symbols(source: str) -> list[tuple[str, str, str, int, int]]:
    """(name, qualified name, kind, first line, last line); none for source that does not parse."""
    out: list[tuple[str, str, str, int, int]] = []

    def visit(body: list[ast.stmt], scope: str) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{scope}.{node.name}" if scope else node.name
                kind = "class" if isinstance(node, ast.ClassDef) else "method" if scope else "function"
                out.append((node.name, name, kind, node.lineno, node.end_lineno or node.lineno))
                visit(node.body, name)
            else:
                for part in ("body", "orelse", "finalbody"):
                    visit(getattr(node, part, []) or [], scope)
                for handler in getattr(node, "handlers", []):
                    visit(handler.body, scope)

    try:
        visit(ast.parse(source).body, "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    return out


_DEFINITION = re.compile(
    r"^(?P<indent>[ \t]*)(?:(?:export|default|public|private|protected|static|final|async|abstract|pub(?:\([a-z]+\))?|unsafe)\s+)*"
    r"(?P<word>class|interface|struct|trait|enum|function|func|fn|def|sub)\s+(?:\([^)]*\)\s*)?(?P<name>[A-Za-z_$][\w$]*)"
)


def other_symbols(source: str) -> list[tuple[str, str, str, int, int]]:
    """Symbols of other languages by their definition lines: an approximation that ends a symbol at the next line indented no deeper."""
    rows = source.split("\n")
    out, scopes = [], []
    for n, row in enumerate(rows):
        m = _DEFINITION.match(row)
        if not m:
            continue
        depth = len(m["indent"].expandtabs(4))
        end = next((k for k in range(n + 1, len(rows)) if rows[k].strip() and len(rows[k].expandtabs(4)) - len(rows[k].expandtabs(4).lstrip()) <= depth), len(rows))
        closing = end < len(rows) and rows[end].strip()[:1] in ("}", "e")
        while scopes and scopes[-1][0] >= depth:
            scopes.pop()
        scope = scopes[-1][1] if scopes else ""
        is_class = m["word"] in ("class", "interface", "struct", "trait", "enum")
        name = f"{scope}.{m['name']}" if scope else m["name"]
        out.append((m["name"], name, "class" if is_class else "method" if scope else "function", n + 1, end + (1 if closing else 0)))
        if is_class:
            scopes.append((depth, name))
    return out


def python_imports(source: str) -> list[tuple[str, str | None, str | None, int]]:
    """(module, imported name, alias, line) of every alias of every import."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[tuple[str, str | None, str | None, int]] = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [(a.name, None, a.asname, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [(node.module or "", a.name, a.asname, node.lineno) for a in node.names]
    return out


def python_calls(source: str) -> list[tuple[str, str, int]]:
    """(caller's qualified name or '', callee's bare name, line), once each."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: dict[tuple[str, str, int], None] = {}

    def visit(node: ast.AST, scope: str) -> None:
        for child in ast.iter_child_nodes(node):
            inner = scope
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                inner = f"{scope}.{child.name}" if scope else child.name
            if isinstance(child, ast.Call):
                name = child.func.id if isinstance(child.func, ast.Name) else child.func.attr if isinstance(child.func, ast.Attribute) else None
                if name:
                    out[(scope, name, child.lineno)] = None
            visit(child, inner)

    visit(tree, "")
    return list(out)


def _parsed(files: DataFrame, schema: str, parse) -> DataFrame:
    """Rows that parse(language, source) gives for each of files (repo_path, git_hash, rel_path, language, source)."""
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"string": pa.string(), "int": pa.int32()}
    fields = pa.schema([(c.split()[0], types[c.split()[1]]) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                key = (row["repo_path"], row["git_hash"], row["rel_path"])
                rows += [(*key, *found) for found in parse(row["language"], row["source"] or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], names)

    return files.select("repo_path", "git_hash", "rel_path", "language", "source").mapInArrow(run, schema)


def extract_symbols(files: DataFrame) -> DataFrame:
    return _parsed(files, SYMBOLS, lambda lang, src: python_symbols(src) if lang == "python" else other_symbols(src) if lang else [])


def extract_imports(files: DataFrame) -> DataFrame:
    return _parsed(files, IMPORTS, lambda lang, src: python_imports(src) if lang == "python" else [])


def extract_calls(files: DataFrame) -> DataFrame:
    return _parsed(files, CALLS, lambda lang, src: python_calls(src) if lang == "python" else [])
